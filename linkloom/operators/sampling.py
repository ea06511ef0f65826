"""Samples and splits that are functions of ids, not of a generator's state or of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 for a key and a seed: the first eight hex digits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the ones with the least draws: one heap per task."""
    return df.withColumn("_u", draw(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def per_group(df: DataFrame, group: Column, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """A sample of each group's size; groups without one give nothing. Spark drops rows beyond the sizes before the shuffle."""
    want = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    most = max(sizes.values())
    w = Window.partitionBy("_g").orderBy("_u", key)
    out = df.withColumn("_g", group).withColumn("_u", draw(F.col(key), seed)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return out.filter(F.col("_r") <= F.coalesce(F.try_element_at(want, F.col("_g")), F.lit(0))).drop("_g", "_u", "_r")


def match_bucket(n: Column) -> Column:
    return F.when(n.between(1, 2), "low (1-2)").when(n.between(3, 6), "mid (3-6)").when(n.between(7, 9), "high (7-9)").when(n == 10, "cap (10)")


#: Sizes of the audit's sample by bucket of match counts.
BUCKET_SIZES = {"low (1-2)": 10, "mid (3-6)": 15, "high (7-9)": 5, "cap (10)": 10}


def strata(country: Column, matches: Column) -> Column:
    return F.concat(country, F.lit("_bin_"), F.least(matches, F.lit(6)).cast("string"))


def split(df: DataFrame, key: str, held: float = 0.2, seed: int = 42) -> DataFrame:
    """With a column ``held``: rows whose draw falls in the first share.

    Each stratum is split in its proportion up to chance, without ranking it,
    so a stratum of a third of all rows costs no more than any other row.
    """
    return df.withColumn("held", draw(F.col(key), seed) < int(held * 2**32))


def fold(key: Column, folds: int = 5, seed: int = 0) -> Column:
    """The fold of a group; all rows of one key share it."""
    return (draw(key, seed) % folds).cast("int")


#: Parts of the draws' range that are counted before any rows are ranked.
PARTS = 4096


def least_draws(df: DataFrame, stratum: Column, key: str, size: Column, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows of each stratum, those with the least draws; ``size`` may use ``_n``, the stratum's rows, and ``_all``.

    Draws are counted in parts of their range, which tells in which part a
    stratum's sample ends; only that part's rows are ranked, so a stratum of
    a third of all rows is spread over all tasks.
    """
    parts = F.floor(F.col("_u") / (2**32 // PARTS)).cast("int")
    rows = df.withColumn("_g", stratum).withColumn("_u", draw(F.col(key), seed)).withColumn("_p", parts)
    counts = rows.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_all"))
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("_n")).crossJoin(F.broadcast(total)).withColumn("_k", size).select("_g", "_k")
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("_b", before).join(sizes, "_g").select("_g", "_p", "_c", "_b", "_k").filter(F.col("_b") < F.col("_k"))
    near = rows.join(places, ["_g", "_p"])
    whole = near.filter(F.col("_b") + F.col("_c") <= F.col("_k"))
    rank = F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_u", key))
    last = near.filter(F.col("_b") + F.col("_c") > F.col("_k")).withColumn("_r", rank).filter(F.col("_b") + F.col("_r") <= F.col("_k")).drop("_r")
    return whole.unionByName(last).drop("_g", "_u", "_p", "_c", "_b", "_k")


def stratified_split(df: DataFrame, stratum: Column, key: str, held: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``held``: of each stratum exactly its share, rounded half to even."""
    some = least_draws(df, stratum, key, F.bround(F.col("_n") * held, 0).cast("long"), seed).select(F.col(key).alias("_key"))
    return df.join(some.withColumn("held", F.lit(True)), F.col(key) == F.col("_key"), "left").drop("_key").withColumn("held", F.coalesce("held", F.lit(False)))


def proportional(df: DataFrame, stratum: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows: of each stratum its share of them, one at least."""
    return least_draws(df, stratum, key, F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_all") * n)), seed)


def by_flag(df: DataFrame, flag: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the flag and n without."""
    return per_group(df, F.col(flag).cast("string"), key, {"true": n, "false": n}, seed)


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    """Keys that two splits share."""
    return a.select(key).intersect(b.select(key)).count()
