"""Predicates and probes over records, key lists and match lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S

# Place names that many countries share, and endings of made-up names.
HOMONYMS = ["paris", "salem", "delhi", "richmond", "columbia", "manchester", "springfield", "london"]
MASK_ENDINGS = ["umbra", "sol", "ira", "lyra", "halo", "calo", "quo", "zazeta", "lum", "flux"]
# Words that a core stem leaves out.
STEM_STOPS = """
sarl eurl sas sasu sa sci snc gie inc corp corporation llc llp ltd limited pvt private co company club centre ecole
association services enterprises trading solutions technologies group holdings
""".split()


def short_name(name: Column) -> Column:
    """At most two words or eight characters."""
    n = F.trim(N.text(name))
    return (F.size(N.tokens(n)) <= 2) | (F.length(n) <= 8)


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, in any case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(N.text(text)), w))


def core_stem(name: Column) -> Column:
    """The lower-cased name without common words and single letters; all of it where nothing is left."""
    low = F.lower(N.text(name))
    own = F.filter(N.tokens(low), lambda w: ~w.isin(STEM_STOPS) & (F.length(w) > 1))
    return F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(low)


def street_digits(address: Column) -> Column:
    """Distinct street numbers as digits, without the reading of letter O as zero."""
    c = F.regexp_replace(F.regexp_replace(N.text(address), "[#№°]", " "), r"(?i)\b(?:no|n°|nº|num|number)\b\.?", " ")
    c = F.regexp_replace(c, r"(\d+)[-/](\d+)", "$1 $2")
    bare = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d+[a-zA-Z]?)\b"), F.lit(1)), lambda t: F.ltrim(F.regexp_replace(t, r"\D", ""), F.lit("0")))
    return F.array_distinct(F.filter(bare, lambda d: F.length(d).between(1, 6)))


def first_number(address: Column) -> Column:
    return F.lower(F.regexp_extract(N.text(address), r"\b(\d+[a-zA-Z]?)\b", 1))


def street_mismatch(a: Column, b: Column, variant: int = 1) -> Column:
    """Whether addresses reject a pair: 1 by numbers; 2 by numbers, else by codes; 3 by doors, codes or numbers."""
    x, y = N.street_numbers(a), N.street_numbers(b)
    numbers = (F.size(x) > 0) & (F.size(y) > 0)
    p, q = N.last_pincode(a), N.last_pincode(b)
    codes = (p != "") & (q != "") & (p != q)
    apart = numbers & ~F.arrays_overlap(x, y)
    if variant == 1:
        return apart
    if variant == 2:
        return F.when(numbers, ~F.arrays_overlap(x, y)).otherwise(codes)
    d, e = N.compound_doors(a), N.compound_doors(b)
    return ((F.size(d) > 0) & (F.size(e) > 0) & ~F.arrays_overlap(d, e)) | codes | apart


def at_cap(counts: DataFrame, cap: int = 10) -> DataFrame:
    """Entities that hold exactly as many matches as the cap allows."""
    return counts.filter(F.col("matches") == cap)


def like_streets(matches: DataFrame, prepared: DataFrame, least: float = 0.70) -> DataFrame:
    """Matches whose street names are alike; ``prepared`` is the feature view of records."""
    side = lambda who, c: prepared.select(F.col("entity_id").alias(who), F.col("r.street_name").alias(c))
    df = matches.join(side("s1", "_a"), "s1").join(side("cand", "_b"), "cand")
    sim = F.when((F.col("_a") != "") & (F.col("_b") != ""), S.similarities(F.col("_a"), F.col("_b"), "token_sort")["token_sort"] / 100).otherwise(0.0)
    return df.filter(sim >= least).select(*matches.columns)


def rescore_above(scored: DataFrame, accepted: DataFrame, tau: float) -> DataFrame:
    """A higher threshold over what a lower one accepted: nothing else can pass, so nothing else is read."""
    return scored.join(accepted.select("s1", "cand"), ["s1", "cand"], "left_semi").filter(F.col("p") >= tau)


def fallback_probe(main: DataFrame, spare: DataFrame, least: int = 5) -> DataFrame:
    """Votes of the main channel, and those of the spare one for entities with fewer than ``least`` main candidates."""
    enough = main.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return main.select("s1", "cand", "votes").unionByName(spare.join(enough, "s1", "left_anti").select("s1", "cand", "votes")).groupBy("s1", "cand").agg(F.sum("votes").alias("votes"))


def candidate_histogram(pairs: DataFrame) -> DataFrame:
    """candidates per entity and entities with as many."""
    return pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("candidates")).groupBy("candidates").agg(F.count(F.lit(1)).alias("entities"))


def against_top(scored: DataFrame) -> DataFrame:
    """Every candidate beside its entity's best one: top_cand, top_p and the distance."""
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "cand")
    return scored.withColumns({"top_cand": F.first("cand").over(w), "top_p": F.first("p").over(w)}).withColumn("distance", F.round(F.col("top_p") - F.col("p"), 9))


def zip_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two files by their place, and whether their ids agree; both carry row_pos and s1."""
    return a.join(b.withColumnRenamed("s1", "other"), "row_pos").withColumn("same", F.col("s1") == F.col("other"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by ``order``, which is unique; keys are merged before the shuffle."""
    first = F.min(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_row"))).alias("_m")
    return df.groupBy(F.col(key).alias("_k")).agg(first).select("_m._row.*")


def lookup(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The rows of a scan whose key is among ``ids``; ids are distinct, so no row is repeated."""
    return df.join(ids.select(ids.columns[0]).distinct(), df[key] == F.col(ids.columns[0]), "left_semi")


def with_distractors(pool: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """The needed records of a pool and its first n rows, each once."""
    head = pool.orderBy("row_pos").limit(n)
    return keep_first(lookup(pool, needed).unionByName(head), "entity_id", "row_pos")
