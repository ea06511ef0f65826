"""Exact de-duplication by skew-safe combining.

Texts are equal when they are identical after deleting space and U+0009 to
U+000D.  Every combining stage groups on the whole normalised text, so two
texts are only ever merged after a full comparison:

1. each map task merges the copies it holds (partial aggregation),
2. its survivors, salted by task, are merged per (digest, text, salt), so a
   text that fills the corpus is spread over ``SALTS`` reducers,
3. the salt winners, at most ``SALTS`` rows a text, are merged per text.

Rows then learn their group through a join on content digests in which no side
carries a text; Spark splits a hot key of that join (adaptive skew join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
#: Characters that do not count.
WHITE_SPACE = " \t\n\x0b\x0c\r"
_SHIFT = "cast(36893488147419103232 as decimal(38,0))"  # 2 ** 65
_TOP = "cast(9223372036854775808 as decimal(38,0))"  # 2 ** 63


def normalised(text: Column) -> Column:
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), WHITE_SPACE, F.coalesce(text, F.lit("")))


def _rank(length: str, key: str) -> Column:
    """Orders rows: longer text first, then smaller id, a null id last; larger is better."""
    return F.expr(f"cast({length} as decimal(38,0)) * {_SHIFT} + coalesce({_TOP} - cast({key} as decimal(38,0)), cast(0 as decimal(38,0)))")


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points in its original form stays,
    then the smallest id.  A null text is empty; empty texts are equal to each
    other.  A null id ranks after all others.  Rows that repeat both id and
    text tie and are all marked kept; :func:`drop_duplicates` leaves one.
    Very long texts are compared whole.  Other columns of ``docs`` are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), normalised(F.col(text)).alias("body"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    rows = rows.select("doc_id", "body", "n", F.sha2("body", 256).alias("text_sha256"), F.xxhash64("body").alias("check"))
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = local.groupBy("text_sha256", "check", "body", "salt").agg(F.max(_rank("n", "doc_id")).alias("best"), F.count(F.lit(1)).alias("members"))
    whole = salted.groupBy("text_sha256", "check", "body").agg(F.max("best").alias("best"), F.sum("members").alias("group_size"))
    keep = F.expr(f"cast({_TOP} - best % {_SHIFT} as long)")
    groups = whole.select(
        F.col("text_sha256").alias("digest"), F.col("check").alias("check2"),
        F.when(F.expr(f"best % {_SHIFT} = 0"), F.lit(None).cast("long")).otherwise(keep).alias("keep_id"),
        F.expr(f"cast(floor(best / {_SHIFT}) as int)").alias("keep_n"), "group_size",
    )
    small = rows.select("doc_id", "n", "text_sha256", "check")
    joined = small.join(groups, (F.col("text_sha256") == F.col("digest")) & (F.col("check") == F.col("check2")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; one of each set of rows that tie.

    Which stays is what :func:`duplicate_groups` says: null texts are empty
    and one of all empty ones stays; a null id stays only where no id has the
    text; rows of one id and text tie, and of these the one of the smallest
    original text and then of the smallest hash of all columns stays; an empty
    table stays empty.
    Tied rows are merged before the shuffle, so a row that is repeated through
    the whole table fills no task.
    """
    stay = duplicate_groups(docs, key, text).filter("kept").select(F.struct("keep_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    # a struct of a null id equals itself; the row is carried whole, so no name of its columns can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.struct(F.col(key).cast("long").alias("keep_id")).alias("row_id"), F.sha2(normalised(F.col(text)), 256).alias("row_sha"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("row_n"), F.col(text).alias("row_text"))
    joined = rows.join(stay, (F.col("row_id") == F.col("stay_id")) & (F.col("row_sha") == F.col("stay_sha")), "left_semi")
    order = F.struct(-F.col("row_n"), F.col("row_text"), F.xxhash64(F.to_json("row"))).alias("row_order")
    dealt = joined.select("row_id", "row_sha", "row", order, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    local = dealt.groupBy("row_id", "row_sha", "salt").agg(F.min_by("row", "row_order").alias("row"), F.min("row_order").alias("row_order"))
    return local.groupBy("row_id", "row_sha").agg(F.min_by("row", "row_order").alias("row")).select("row.*")
