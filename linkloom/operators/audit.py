"""Audits of matched pairs: failure modes, labels and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S


def prepare(records: DataFrame) -> DataFrame:
    """entity_id and the audit's view of a record, computed once per record."""
    name, addr = F.col("business_name"), F.col("business_address")
    street = N.audit_street_tokens(addr)
    return records.select("entity_id", F.struct(
        N.audit_clean(name).alias("name"), N.audit_clean(addr).alias("addr"), N.audit_core(name).alias("core"), N.audit_street_number(addr).alias("number"),
        street.alias("street"), F.array_join(F.array_sort(street), " ").alias("street_name"),
    ).alias("x"))


def metrics(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The audit's similarities, from 0 to 1, for pairs (s1, cand, ...)."""
    side = lambda who, r: prepare(records).select(F.col("entity_id").alias(who), F.col("x").alias(r))
    df = pairs.join(side("s1", "a"), "s1").join(side("cand", "b"), "cand")
    sim = lambda f, *k: S.similarities(F.col(f"a.{f}"), F.col(f"b.{f}"), *k)
    df = df.withColumns({"_n": sim("name", "ratio", "token_sort"), "_d": sim("addr", "ratio", "token_sort"), "_c": sim("core", "ratio", "token_sort"), "_s": sim("street_name", "token_sort")})
    words = lambda f: (F.array_distinct(N.tokens(F.col(f"a.{f}"))), F.array_distinct(N.tokens(F.col(f"b.{f}"))))
    core, streets = (F.col("a.core") != "") & (F.col("b.core") != ""), (F.col("a.street_name") != "") & (F.col("b.street_name") != "")
    numbers = (F.col("a.number") != "") & (F.col("b.number") != "")
    return df.withColumns({
        "name_lev": F.col("_n.ratio") / 100, "name_tok_sort": F.col("_n.token_sort") / 100, "addr_lev": F.col("_d.ratio") / 100, "addr_tok_sort": F.col("_d.token_sort") / 100,
        "addr_jaccard": S.jaccard(*words("addr")), "core_name_lev": F.when(core, F.col("_c.ratio")).otherwise(F.col("_n.ratio")) / 100,
        "core_name_tok_sort": F.when(core, F.col("_c.token_sort")).otherwise(F.col("_n.token_sort")) / 100,
        "core_name_jaccard": F.when(core, S.jaccard(*words("core"))).otherwise(S.jaccard(*words("name"))),
        "num_match": numbers & (F.col("a.number") == F.col("b.number")), "num_mismatch": numbers & (F.col("a.number") != F.col("b.number")),
        "st_jaccard": S.jaccard(F.col("a.street"), F.col("b.street")), "st_sim": F.when(streets, F.col("_s.token_sort") / 100).otherwise(0.0),
    }).drop("a", "b", "_n", "_d", "_c", "_s")


#: The names of :func:`modes`.
MODES = ("mode1_colocation", "mode2_suffix_inflation", "mode3_franchise", "mode4_street_mismatch", "mode5_low_mutual", "old_flagged", "expanded_flagged")


def modes() -> dict[str, Column]:
    """The five failure modes, the older flag, and whether any holds, over :func:`metrics` columns."""
    c = F.col
    high = lambda a, b, t: (c(a) >= t) | (c(b) >= t)
    low = lambda a, b, t: (c(a) < t) & (c(b) < t)
    old = (high("addr_lev", "addr_tok_sort", 0.90) & low("name_lev", "name_tok_sort", 0.60)) | (high("name_lev", "name_tok_sort", 0.85) & low("addr_lev", "addr_tok_sort", 0.40))
    out = {
        "mode1_colocation": ((c("addr_tok_sort") >= 0.80) | (c("addr_jaccard") >= 0.50) | (c("num_match") & (c("st_sim") >= 0.60))) & (c("core_name_tok_sort") < 0.55) & (c("core_name_jaccard") < 0.35),
        "mode2_suffix_inflation": (c("core_name_jaccard") == 0.0) & (c("core_name_tok_sort") < 0.40) & (c("name_tok_sort") >= 0.55),
        "mode3_franchise": ((c("core_name_tok_sort") >= 0.75) | (c("name_tok_sort") >= 0.80)) & (c("addr_tok_sort") < 0.45) & (c("addr_jaccard") < 0.30) & (c("st_jaccard") == 0.0),
        "mode4_street_mismatch": c("num_match") & (c("st_jaccard") == 0.0) & (c("st_sim") < 0.35) & (c("core_name_tok_sort") < 0.85),
        "mode5_low_mutual": (c("core_name_tok_sort") < 0.65) & (c("core_name_jaccard") < 0.40) & (c("addr_tok_sort") < 0.65) & (c("addr_jaccard") < 0.40),
        "old_flagged": old,
    }
    some = old
    for k in out:
        some = some | out[k]
    return out | {"expanded_flagged": some}


def reconcile_modes() -> dict[str, Column]:
    """The same modes with the thresholds of the reconciling audit."""
    c = F.col
    return {
        "mode1_colocation": ((c("addr_tok_sort") >= 0.85) | (c("num_match") & (c("addr_jaccard") >= 0.50))) & (c("core_name_lev") < 0.60) & (c("core_name_jaccard") < 0.45),
        "mode2_suffix_inflation": ((c("core_name_jaccard") == 0.0) | (c("core_name_lev") < 0.40)) & (c("core_name_lev") < c("name_lev") - 0.20),
        "mode3_franchise": ((c("name_tok_sort") >= 0.80) | (c("core_name_lev") >= 0.85)) & (c("addr_tok_sort") < 0.50) & (c("addr_jaccard") < 0.35),
        "mode4_street_mismatch": c("num_match") & (c("addr_jaccard") < 0.30) & (c("addr_lev") < 0.55) & (c("name_tok_sort") < 0.80),
        "mode5_low_mutual": (c("name_tok_sort") < 0.70) & (c("core_name_lev") < 0.65) & (c("addr_tok_sort") < 0.70),
    }


def label() -> Column:
    """GENUINE_MATCH, LIKELY_FALSE_MATCH or AMBIGUOUS: the first rule that holds."""
    c = F.col
    return (
        F.when(((c("core_name_tok_sort") >= 0.75) | (c("name_tok_sort") >= 0.85)) & ((c("addr_tok_sort") >= 0.70) | (c("st_sim") >= 0.70) | ((c("addr_tok_sort") >= 0.65) & c("num_match"))), "GENUINE_MATCH")
        .when((c("core_name_tok_sort") < 0.50) & (c("core_name_jaccard") < 0.25), "LIKELY_FALSE_MATCH")
        .when(c("num_match") & (c("st_jaccard") == 0.0) & (c("st_sim") < 0.35) & (c("core_name_tok_sort") < 0.80), "LIKELY_FALSE_MATCH")
        .when((c("core_name_tok_sort") >= 0.80) & (c("addr_tok_sort") < 0.45) & (c("st_jaccard") == 0.0), "LIKELY_FALSE_MATCH")
        .when((c("core_name_tok_sort") < 0.65) & (c("addr_tok_sort") < 0.60), "LIKELY_FALSE_MATCH")
        .when(c("mode2_suffix_inflation"), "LIKELY_FALSE_MATCH")
        .when((c("core_name_tok_sort") >= 0.65) & (c("addr_tok_sort") >= 0.65), "GENUINE_MATCH")
        .otherwise("AMBIGUOUS")
    )


def suspicious(name_sim: Column, addr_sim: Column, same_place: Column) -> tuple[Column, Column]:
    """Unlike names at one address, and like names at unlike addresses that share no code or city."""
    return (addr_sim >= 0.90) & (name_sim < 0.60), (name_sim >= 0.85) & (addr_sim < 0.40) & ~same_place


def mode_counts(audited: DataFrame) -> DataFrame:
    """Per country: pairs, flagged pairs, and pairs of each mode with their share of the flagged ones."""
    names = [k for k in MODES if k.startswith("mode")]
    flagged = F.count_if("expanded_flagged")
    return audited.groupBy("country").agg(
        F.count(F.lit(1)).alias("pairs"), flagged.alias("flagged"), *[F.count_if(n).alias(n) for n in names],
        *[F.round(100 * F.count_if(n) / F.greatest(flagged, F.lit(1)), 6).alias(f"{n}_pct") for n in names],
    )


def error_rates(labelled: DataFrame) -> DataFrame:
    """Share of false (strict), and of false or ambiguous (conservative), pairs by flag; rows carry expanded_flagged and label."""
    false = (F.col("label") == "LIKELY_FALSE_MATCH").cast("double")
    doubt = (F.col("label") != "GENUINE_MATCH").cast("double")
    return labelled.groupBy(F.col("expanded_flagged").alias("flagged")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(false), 6).alias("strict"), F.round(F.avg(doubt), 6).alias("conservative"))


def similarity_histogram(pairs: DataFrame, sim: str, flag: str) -> DataFrame:
    return pairs.groupBy(N.similarity_bucket(F.col(sim)).alias("bucket"), F.col(flag).alias("flagged")).agg(F.count(F.lit(1)).alias("pairs"))


def share_above(pairs: DataFrame, cuts: list[float], *sims: str) -> DataFrame:
    """For each cut the share of pairs whose best similarity reaches it."""
    best = F.greatest(*sims)
    row = pairs.agg(*[F.round(F.avg((best >= c).cast("double")), 6).alias(f"c{i}") for i, c in enumerate(cuts)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{i}").alias("share")) for i, c in enumerate(cuts)])))


def contained(a: Column, b: Column) -> Column:
    """Whether the letters and digits of one text hold those of the other."""
    x, y = (F.regexp_replace(F.lower(N.text(c)), "[^a-z0-9]", "") for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def has_suffix(words: Column, endings: list[str]) -> Column:
    """Whether any word ends with one of the endings."""
    return F.exists(words, lambda w: w.rlike("(?:" + "|".join(endings) + ")$"))
