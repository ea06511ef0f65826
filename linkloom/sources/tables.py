"""Scans and sinks.

Tab-separated records are read as strings without quoting, ragged rows and
missing fields give empty strings, and ``row_pos`` keeps the order of the file,
which counts in outputs.  Writers go through Spark's commit protocol, so a
table appears whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def _strings(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str] = RECORD, header: bool = True) -> DataFrame:
    """All-string rows of a tab-separated file; no quoting; null and missing fields are empty."""
    df = spark.read.schema(_strings(columns)).option("sep", "\t").option("quote", "").option("header", header).option("mode", "PERMISSIVE").csv(path)
    return df.na.fill("")


def read_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The same from raw lines, in file order: columns and row_pos; a short line gives empty fields, the header has row_pos 0.

    The position is the line's place within its file's splits, so it orders
    rows but has gaps; a file in one split has none.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row_pos"))
    parts = F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\t")
    return lines.select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], "row_pos")


def with_row_pos(df: DataFrame) -> DataFrame:
    """``df`` with a column row_pos that rises in the order of its scan."""
    return df.withColumn("row_pos", F.monotonically_increasing_id())


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by row_pos, found with one heap per task."""
    return df.orderBy("row_pos").limit(n)


def source_of(entity_id: Column) -> Column:
    return F.split_part(entity_id, F.lit("-"), F.lit(1))


def parse_ids(ids: Column) -> Column:
    """A comma list as an array of trimmed, non-empty ids."""
    return F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def edges(df: DataFrame, s1: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s1, cand, pos) rows of a table of id lists."""
    return df.select(F.col(s1).alias("s1"), F.posexplode(parse_ids(F.col(ids))).alias("pos", "cand")).select("s1", "cand", "pos")


def id_lists(pairs: DataFrame, order: Sequence[str] = ("rank", "cand"), name: str = "ids") -> DataFrame:
    """One comma list for each s1, in the given order."""
    return pairs.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("cand").alias("id")))).alias("x")).select("s1", F.array_join(F.transform("x", lambda x: x["id"]), ",").alias(name))


def stitch(s1: DataFrame, lists: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each S1 entity, in file order; entities without a list get empty ones."""
    joined = s1.select(F.col("entity_id").alias("s1"), "row_pos").join(lists, "s1", "left")
    return joined.select("row_pos", F.col("s1").alias("source1_entity_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_tsv(df: DataFrame, path: str, single: bool = True) -> None:
    """A tab-separated file with a header; rows by row_pos if there is one, and spaces at the ends of fields stay. ``single`` asks for one file, else one per range."""
    if "row_pos" in df.columns:
        df = df.orderBy("row_pos").drop("row_pos")
    (df.coalesce(1) if single else df).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_by_country(df: DataFrame, path: str) -> None:
    """One folder for each country; readers that filter on country skip the others."""
    df.write.mode("overwrite").partitionBy("country").parquet(path)


def write_thresholds(scored: DataFrame, path: str, taus: Sequence[float], prob: str = "p") -> None:
    """One pass over scored pairs, one folder for each threshold."""
    fan = scored.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).filter(F.col(prob) >= F.col("tau"))
    fan.write.mode("overwrite").partitionBy("tau").parquet(path)


def confidence_rows(df: DataFrame) -> DataFrame:
    """Probabilities as text of four decimals, for a confidence file."""
    return df.withColumns({c: F.format_string("%.4f", F.col(c).cast("double")) for c in ("min_match_probability", "mean_match_probability")})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated blocks of a text report: block and its text."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("block"), F.trim("value").alias("text")).filter("text <> ''")


def write_report(pairs: DataFrame, path: str, pattern: str, columns: Sequence[str]) -> None:
    """A human-readable dump: one formatted line for each row."""
    pairs.select(F.format_string(pattern, *columns)).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def content_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive hash of all columns, to compare frames without collecting them."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
