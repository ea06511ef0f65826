"""The 49 features of a pair of records.

Everything that depends on one record alone is computed once per record,
before the join; pairs are compared in one pass of the similarity kernels, and
the rest is arithmetic on columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S

COLUMNS = """
name_levenshtein name_jaro_winkler name_token_sort name_token_set name_partial_ratio name_jaccard name_common_tokens
name_acronym_match name_length_diff name_length_ratio name_token_count_diff name_transliterated_sim legal_suffix_match
core_name_lev core_name_tok_sort core_name_jaccard name_suffix_inflation_gap s1_addr_missing cand_addr_missing
either_addr_missing both_addr_present addr_levenshtein addr_jaro_winkler addr_token_sort addr_token_set
addr_partial_ratio addr_jaccard addr_common_tokens pin_exact_match pin_mismatch street_number_match
street_number_mismatch street_name_sim st_name_jaccard street_mismatch_with_shared_num street_diff_flag
exact_name_match exact_addr_match city_exact_match addr_length_diff country_exact_match candidate_source sim_max
sim_mean interaction_name_addr interaction_core_name_addr sim_ratio interaction_name_pin interaction_name_street
""".split()


def prepare(records: DataFrame, *more: str) -> DataFrame:
    """What pair features need of one normalised record, as a struct ``r`` beside its id and the columns ``more``."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    core = N.core_tokens(name)
    return records.select("entity_id", *more, F.struct(
        name.alias("name"), addr.alias("addr"), F.array_distinct(N.tokens(name)).alias("words"), N.tokens(name).alias("seq"), F.array_distinct(N.tokens(addr)).alias("addr_words"),
        N.transliterate(name).alias("latin"), F.col("legal_suffix").alias("suffix"), F.array_join(core, " ").alias("core"), F.array_distinct(core).alias("core_words"),
        N.street_tokens(addr, F.col("city_extracted")).alias("street"), F.array_join(F.array_sort(N.street_tokens(addr, F.col("city_extracted"))), " ").alias("street_name"),
        F.col("pin_extracted").alias("pin"), F.col("street_number").alias("number"), F.col("city_extracted").alias("city"), F.col("country").alias("country"),
    ).alias("r"))


def _flag(c: Column) -> Column:
    return c.cast("double")


def structural(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The features that need no similarity kernel, over record structs ``a`` and ``b``."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    both = lambda f: (x(f) != "") & (y(f) != "")
    agree = lambda f: _flag(both(f) & (x(f) == y(f)))
    differ = lambda f: _flag(both(f) & (x(f) != y(f)))
    n, m = F.length(x("name")), F.length(y("name"))
    return {
        "name_jaccard": S.jaccard(x("words"), y("words")),
        "name_common_tokens": _flag(S.common(x("words"), y("words"))),
        "name_acronym_match": _flag(S.acronym_match(x("seq"), y("seq"))),
        "name_length_diff": _flag(F.abs(n - m)),
        "name_length_ratio": F.least(n, m) / F.greatest(n, m, F.lit(1)),
        "name_token_count_diff": _flag(F.abs(F.size(x("seq")) - F.size(y("seq")))),
        "legal_suffix_match": F.when(both("suffix"), F.when(x("suffix") == y("suffix"), 1.0).otherwise(-1.0)).otherwise(0.0),
        "core_name_jaccard": S.jaccard(x("core_words"), y("core_words")),
        "s1_addr_missing": _flag(x("addr") == ""),
        "cand_addr_missing": _flag(y("addr") == ""),
        "either_addr_missing": _flag((x("addr") == "") | (y("addr") == "")),
        "both_addr_present": _flag(both("addr")),
        "addr_jaccard": S.jaccard(x("addr_words"), y("addr_words")),
        "addr_common_tokens": _flag(S.common(x("addr_words"), y("addr_words"))),
        "pin_exact_match": agree("pin"), "pin_mismatch": differ("pin"),
        "street_number_match": agree("number"), "street_number_mismatch": differ("number"),
        "st_name_jaccard": S.jaccard(x("street"), y("street")),
        "exact_name_match": agree("name"), "exact_addr_match": agree("addr"), "city_exact_match": agree("city"),
        "addr_length_diff": _flag(F.abs(F.length(x("addr")) - F.length(y("addr")))),
        "country_exact_match": _flag(x("country") == y("country")),
    }


def pair_features(pairs: DataFrame, s1: DataFrame, cands: DataFrame) -> DataFrame:
    """s1, cand and the 49 features for each pair of ids; pairs without a record on a side are dropped."""
    side = lambda df, who, r: prepare(df).select(F.col("entity_id").alias(who), F.col("r").alias(r))
    df = pairs.select("s1", "cand").join(side(s1, "s1", "a"), "s1").join(side(cands, "cand", "b"), "cand")
    sim = lambda f, *names: S.similarities(F.col(f"a.{f}"), F.col(f"b.{f}"), *names)
    df = df.withColumns({"_name": sim("name", *S.KERNELS), "_addr": sim("addr", *S.KERNELS), "_core": sim("core", "ratio", "token_sort"), "_street": sim("street_name", "token_sort"), "_latin": sim("latin", "token_sort")})
    df = df.withColumns(structural())
    here = F.col("both_addr_present") == 1.0
    core = (F.col("a.core") != "") & (F.col("b.core") != "")
    streets = (F.col("a.street_name") != "") & (F.col("b.street_name") != "")
    df = df.withColumns({
        "name_levenshtein": F.col("_name.ratio") / 100, "name_jaro_winkler": F.col("_name.jaro_winkler"), "name_token_sort": F.col("_name.token_sort") / 100,
        "name_token_set": F.col("_name.token_set") / 100, "name_partial_ratio": F.col("_name.partial") / 100, "name_transliterated_sim": F.col("_latin.token_sort") / 100,
        "core_name_lev": F.when(core, F.col("_core.ratio")).otherwise(F.col("_name.ratio")) / 100,
        "core_name_tok_sort": F.when(core, F.col("_core.token_sort")).otherwise(F.col("_name.token_sort")) / 100,
        "street_name_sim": F.when(streets, F.col("_street.token_sort") / 100).otherwise(0.0),
        **{f"addr_{out}": F.when(here, F.col(f"_addr.{k}") / scale).otherwise(0.0) for out, k, scale in (("levenshtein", "ratio", 100), ("jaro_winkler", "jaro_winkler", 1), ("token_sort", "token_sort", 100), ("token_set", "token_set", 100), ("partial_ratio", "partial", 100))},
        "candidate_source": F.when(F.col("cand").startswith("S2-"), 2.0).when(F.col("cand").startswith("S3-"), 3.0).otherwise(0.0),
    })
    return df.withColumns(interactions()).select("s1", "cand", *COLUMNS)


def interactions() -> dict[str, Column]:
    """The features that are arithmetic on others."""
    c = F.col
    far = (c("st_name_jaccard") < 0.2) & (c("street_name_sim") < 0.35)
    return {
        "name_suffix_inflation_gap": F.greatest(F.lit(0.0), c("name_token_sort") - c("core_name_tok_sort")),
        "street_mismatch_with_shared_num": _flag((c("street_number_match") == 1) & (c("st_name_jaccard") == 0) & (c("street_name_sim") < 0.35)),
        "street_diff_flag": _flag((c("street_number_mismatch") == 1) & far),
        "sim_max": F.greatest("name_jaro_winkler", "addr_token_sort"),
        "sim_mean": (c("name_jaro_winkler") + c("addr_token_sort")) / 2,
        "interaction_name_addr": c("name_jaro_winkler") * c("addr_token_sort"),
        "interaction_core_name_addr": c("core_name_tok_sort") * c("addr_token_sort"),
        "sim_ratio": c("core_name_tok_sort") / (c("addr_token_sort") + 0.01),
        "interaction_name_pin": c("name_jaro_winkler") * c("pin_exact_match"),
        "interaction_name_street": c("name_jaro_winkler") * c("street_number_match"),
    }


def deepened(pairs: DataFrame) -> DataFrame:
    """Experimental features over pair features with the raw addresses s1_raw and cand_raw beside them."""
    x, y = N.suite(F.col("s1_raw")), N.suite(F.col("cand_raw"))
    both = (x != "") & (y != "")
    return pairs.withColumns({
        "suite_exact_match": _flag(both & (x == y)),
        "same_bldg_diff_suite": _flag(both & (x != y) & (F.col("street_number_match") == 1)),
        "brand_match_city_mismatch": _flag((F.col("core_name_tok_sort") >= 0.85) & (F.col("city_exact_match") == 0) & (F.col("both_addr_present") == 1)),
        "co_location_divergence_penalty": F.greatest(F.lit(0.0), F.col("addr_token_sort") - F.col("core_name_tok_sort")),
    })
