"""Checks of output files, each a query: rows (rule, severity, count, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Examples of a finding, the first in order.
EXAMPLES = 5


def _finding(rule: str, bad: DataFrame, of: str, severity: str = "error") -> DataFrame:
    """A row for a rule; the examples are a bounded top-k, the count is over all rows."""
    top = bad.select(F.col(of).cast("string").alias("x")).distinct().orderBy("x").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    n = bad.agg(F.count(F.lit(1)).alias("count"))
    return n.crossJoin(F.broadcast(top)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "count", "examples")


def findings(lists: DataFrame, s1_ids: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """All rules over an output table (s1, ids array), the ids that S1 has (s1) and those that may be matched (cand).

    ``candidates`` (s1, cand) adds the warning for matches outside them.
    """
    edges = lists.select("s1", F.explode("ids").alias("cand"))
    repeated = lists.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = [
        _finding("duplicate_s1", repeated, "s1"),
        _finding("duplicate_id", lists.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "s1"),
        _finding("self_match", edges.filter("s1 = cand"), "s1"),
        _finding("bad_prefix", edges.filter(~F.col("cand").rlike("^S[23]-")), "cand"),
        _finding("unknown_id", edges.join(known.select("cand"), "cand", "left_anti"), "cand"),
        _finding("missing_s1", s1_ids.select("s1").join(lists.select("s1"), "s1", "left_anti"), "s1"),
        _finding("extra_s1", lists.select("s1").join(s1_ids.select("s1"), "s1", "left_anti"), "s1"),
    ]
    if candidates is not None:
        out.append(_finding("outside_candidates", edges.join(candidates.select("s1", "cand"), ["s1", "cand"], "left_anti"), "s1", "warning"))
    return reduce(DataFrame.unionByName, out)


def file_findings(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """Rules over raw lines (row_pos, value): an empty file, a wrong header (case does not count), rows without two fields."""
    fields = F.split(F.col("value"), "\t")
    first = lines.orderBy("row_pos").limit(1)
    right = F.lower(F.concat_ws("\t", F.trim(F.get(fields, F.lit(0))), F.trim(F.get(fields, F.lit(1))))) == "\t".join(header).lower()
    empty = lines.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("file").alias("value"))
    body = lines.join(F.broadcast(first.select(F.col("row_pos").alias("head"))), F.col("row_pos") != F.col("head"))
    return reduce(DataFrame.unionByName, [_finding("empty_file", empty, "value"), _finding("wrong_header", first.filter(~right), "value"), _finding("malformed_row", body.filter(F.size(fields) != 2), "value")])


def containment(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches in all and outside the candidates."""
    m = matches.join(candidates.select("s1", "cand", F.lit(1).alias("inside")), ["s1", "cand"], "left")
    return m.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("inside").isNull()).alias("outside"))


def id_integrity(ids: DataFrame, column: str) -> DataFrame:
    """Ids in all, distinct, with spaces, with odd characters, and empty."""
    c = F.col(column)
    return ids.agg(
        F.count(F.lit(1)).alias("ids"), F.countDistinct(c).alias("distinct_ids"), F.count_if(F.coalesce(c != F.trim(c), F.lit(False))).alias("spaced"),
        F.count_if(F.coalesce(~c.rlike("^[A-Za-z0-9_-]*$"), F.lit(False))).alias("odd"), F.count_if(c.isNull() | (c == "")).alias("empty"),
    )


def invariants(lists: DataFrame, match_cap: int = 10, cand_cap: int = 12) -> DataFrame:
    """Rows in all, over a cap, and with matches that aren't candidates; rows carry arrays matches and cands."""
    return lists.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("matches") > match_cap).alias("over_match_cap"), F.count_if(F.size("cands") > cand_cap).alias("over_cand_cap"),
        F.count_if(F.size(F.array_except("matches", "cands")) > 0).alias("not_contained"),
    )


def enforce(lists: DataFrame, match_cap: int = 10, cand_cap: int = 12) -> DataFrame:
    """Matches cut to their cap, candidates with the matches first, cut to theirs."""
    m = F.slice("matches", 1, match_cap)
    return lists.withColumn("matches", m).withColumn("cands", F.slice(F.array_distinct(F.concat(m, "cands")), 1, cand_cap))


def country_leaks(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs in all and across countries."""
    side = lambda who, c: records.select(F.col("entity_id").alias(who), F.col("country").alias(c))
    joined = pairs.join(side("s1", "c1"), "s1").join(side("cand", "c2"), "cand")
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("c1") != F.col("c2")).alias("across"))


def order_kept(out: DataFrame, s1: DataFrame) -> DataFrame:
    """Rows in all, and those whose place isn't their entity's in S1; row_pos counts from 0 in both tables (s1, row_pos)."""
    joined = out.select("s1", F.col("row_pos").alias("here")).join(s1.select("s1", F.col("row_pos").alias("there")), "s1")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("here") != F.col("there")).alias("out_of_order"))


def check(holds: Column, message: str) -> Column:
    """Null where the condition holds; stops the query where it does not."""
    return F.assert_true(holds, F.lit(message))


def checklist(matches: DataFrame, candidates: DataFrame, s1_ids: DataFrame, countries: DataFrame, headers: DataFrame, validated: DataFrame) -> DataFrame:
    """The ten items of the final check: item, violations, passed.

    ``matches`` and ``candidates`` hold id lists (s1, ids), ``countries`` an
    (entity_id, country) row for each record, ``headers`` (given, wanted) rows
    and ``validated`` the rows of :func:`findings`.  Item 8, the match rate,
    only reports and counts entities without a match.
    """
    n = s1_ids.agg(F.count(F.lit(1)).alias("wanted"))
    rows = matches.groupBy("s1").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("ids")).alias("longest"), F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("repeats"), F.flatten(F.collect_list("ids")).alias("ids"))
    cand = candidates.groupBy("s1").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("c_repeats"), F.flatten(F.collect_list("ids")).alias("c_ids"))
    known = s1_ids.select("s1", F.lit(1).alias("known")).distinct()
    joined = rows.join(cand, "s1", "full").join(known, "s1", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = F.size(F.array_except("ids", F.coalesce("c_ids", F.array().cast("array<string>"))))
    sums = joined.agg(
        F.count_if((zero("m") != 1) | (zero("known") == 0)).alias("i1"), F.sum(F.greatest(zero("m") - 1, F.lit(0)) + F.greatest(zero("c") - 1, F.lit(0))).alias("i2"), F.sum(zero("repeats") + zero("c_repeats")).alias("i3"),
        F.sum(F.coalesce(F.size(F.filter("ids", lambda x: ~x.rlike("^S[23]-"))), F.lit(0))).alias("i4"), F.count_if(F.coalesce(out, F.lit(0)) > 0).alias("i5"), F.count_if((zero("known") == 1) & (zero("longest") == 0)).alias("i8"),
        F.sum(zero("m")).alias("m_rows"), F.sum(zero("c")).alias("c_rows"),
    )
    place = lambda who, c: countries.select(F.col("entity_id").alias(who), F.col("country").alias(c))
    edges = matches.select("s1", F.explode("ids").alias("cand")).join(place("s1", "a"), "s1").join(place("cand", "b"), "cand")
    across = edges.agg(F.count_if(F.col("a") != F.col("b")).alias("i6"))
    heads = headers.agg(F.count_if(F.lower("given") != F.lower("wanted")).alias("i7"))
    errors = validated.filter("severity = 'error'").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("i9"))
    one = sums.crossJoin(n).crossJoin(across).crossJoin(heads).crossJoin(errors)
    one = one.withColumn("i10", F.abs(F.col("m_rows") - F.col("wanted")) + F.abs(F.col("c_rows") - F.col("wanted")))
    items = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"i{i}").cast("long").alias("violations"), (F.lit(i == 8) | (F.col(f"i{i}") == 0)).alias("passed")) for i in range(1, 11)])
    return one.select(F.inline(items))
