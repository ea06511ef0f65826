"""Queries over filters and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import audit, decide, evaluate, features, filters
from linkloom.plans import pair_queries as P
from linkloom.plans import relations as R

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {R.RECORDS} SELECT entity_id, business_name FROM records WHERE len(list_filter(string_split(business_name, ' '), lambda x: x <> '')) <= 2 OR length(business_name) <= 8")
def short_names(spark, d) -> DataFrame:
    return R.records(spark, d).filter(filters.short_name(F.col("business_name"))).select("entity_id", "business_name")


#: Places that some addresses name: a homonym for every twelfth record.
_TOWN = f"business_address || CASE WHEN row_pos % 12 = 0 THEN ', ' || ([{', '.join(f"'{h.title()}'" for h in filters.HOMONYMS)}])[row_pos % {len(filters.HOMONYMS)} + 1] ELSE '' END"


@query(f"WITH {R.RECORDS}, t AS (SELECT entity_id, lower({_TOWN}) AS x FROM records) SELECT entity_id FROM t WHERE {' OR '.join(f"contains(x, '{h}')" for h in filters.HOMONYMS)}")
def keyword_filter(spark, d) -> DataFrame:
    town = F.element_at(F.array(*[F.lit(h.title()) for h in filters.HOMONYMS]), (F.col("row_pos") % len(filters.HOMONYMS) + 1).cast("int"))
    address = F.concat("business_address", F.when(F.col("row_pos") % 12 == 0, F.concat(F.lit(", "), town)).otherwise(""))
    return R.records(spark, d).filter(filters.any_keyword(address, filters.HOMONYMS)).select("entity_id")


_STEM = f"list_filter(string_split(lower(business_name), ' '), lambda x: length(x) > 1 AND x NOT IN ({R._list(filters.STEM_STOPS)}))"


@query(f"WITH {R.RECORDS} SELECT entity_id, CASE WHEN len({_STEM}) > 0 THEN array_to_string({_STEM}, ' ') ELSE lower(business_name) END AS stem FROM records")
def core_stem(spark, d) -> DataFrame:
    return R.records(spark, d).select("entity_id", filters.core_stem(F.col("business_name")).alias("stem"))


@query(f"WITH {R.RECORDS} SELECT entity_id, len(list_filter(string_split(lower(business_name), ' '), lambda x: regexp_matches(x, '({'|'.join(filters.MASK_ENDINGS)})$'))) > 0 AS masked FROM records")
def synthetic_mask(spark, d) -> DataFrame:
    return R.records(spark, d).select("entity_id", audit.has_suffix(F.split(F.lower("business_name"), " "), filters.MASK_ENDINGS).alias("masked"))


@query(f"WITH {P._COUNTS} SELECT s1 FROM counts WHERE matches = 2")
def cap_bin(spark, d) -> DataFrame:
    return filters.at_cap(P._counts(spark, d), 2).select("s1")


@query(f"WITH {R.PAIRS}, c AS (SELECT s1, count(*) AS candidates FROM pairs GROUP BY s1) SELECT candidates, count(*) AS entities FROM c GROUP BY candidates")
def candidate_histogram(spark, d) -> DataFrame:
    return filters.candidate_histogram(R.pairs(spark, d))


@query(f"WITH {R.SCORED} SELECT s1, cand, p, first_value(cand) OVER (PARTITION BY s1 ORDER BY rank) AS top_cand, p1 AS top_p, round(p1 - p, 9) AS distance FROM ranked")
def against_top(spark, d) -> DataFrame:
    return filters.against_top(P._scored(spark, d).select("s1", "cand", "p"))


@query(f"WITH {R.SCORED} SELECT s1, cand, p FROM scored WHERE p >= 0.6")
def pruned_rescore(spark, d) -> DataFrame:
    scored = P._scored(spark, d).select("s1", "cand", "p")
    return filters.rescore_above(scored, decide.fixed_tau(scored, 0.3, None), 0.6)


@query(f"WITH {P._MATCHED}, alnum AS (SELECT s1, cand, regexp_replace(lower(a.business_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b.business_name), '[^a-z0-9]', '', 'g') AS y FROM scored JOIN norm a ON a.entity_id = s1 JOIN norm b ON b.entity_id = cand) SELECT s1, cand, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS contained FROM alnum")
def alnum_containment(spark, d) -> DataFrame:
    recs = R.records(spark, d)
    name = lambda who, c: recs.select(F.col("entity_id").alias(who), F.col("business_name").alias(c))
    return P._scored(spark, d).join(name("s1", "x"), "s1").join(name("cand", "y"), "cand").select("s1", "cand", audit.contained(F.col("x"), F.col("y")).alias("contained"))


@query(f"WITH RECURSIVE {R.SIMMED}, t AS (SELECT unnest([20.0, 50.0, 80.0])::DOUBLE AS cut) SELECT cut, round(avg(CASE WHEN greatest(name_sim, addr_sim) >= cut THEN 1.0 ELSE 0.0 END), 6) AS share FROM simmed, t GROUP BY cut")
def share_above(spark, d) -> DataFrame:
    return audit.share_above(P._with_sims(spark, d), [20.0, 50.0, 80.0], "name_sim", "addr_sim")


@query(f"WITH {R.NORM}, again AS (SELECT entity_id, CASE WHEN row_pos % 100 = 0 THEN name_norm || '!' ELSE name_norm END AS name_norm, addr_norm FROM norm) SELECT (SELECT count(*) FROM norm) AS rows, (SELECT count(*) FROM (SELECT entity_id, name_norm, addr_norm FROM norm EXCEPT ALL SELECT * FROM again)) + (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT entity_id, name_norm, addr_norm FROM norm)) AS differing")
def determinism_check(spark, d) -> DataFrame:
    """The normalised table made twice over different partitionings, every hundredth name changed on purpose, and rows that differ."""
    a = R.normalized(spark, d).select("entity_id", "name_norm", "addr_norm")
    b = R.N.normalize(R.records(spark, d).repartition(7, "entity_id"))
    b = b.select("entity_id", F.when(F.col("row_pos") % 100 == 0, F.concat("name_norm", F.lit("!"))).otherwise(F.col("name_norm")).alias("name_norm"), "addr_norm")
    return a.agg(F.count(F.lit(1)).alias("rows")).crossJoin(a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differing")))


@query(f"""WITH {R.SCORED}, {R.TRUTH}, {R.ENTITIES}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS tau),
per AS (SELECT tau, e.s1, (SELECT count(*) FROM truth x WHERE x.s1 = e.s1) AS n, (SELECT count(*) FROM scored y WHERE y.s1 = e.s1 AND y.p >= tau) AS m, (SELECT count(*) FROM scored y JOIN truth x ON x.s1 = y.s1 AND x.cand = y.cand WHERE y.s1 = e.s1 AND y.p >= tau) AS tp FROM entities e, t),
sw AS (SELECT tau, round(avg(CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp::DOUBLE / m) * (tp::DOUBLE / n) / (0.25 * (tp::DOUBLE / m) + tp::DOUBLE / n) END), 6) AS f05 FROM per GROUP BY tau)
SELECT tau, f05 FROM sw ORDER BY f05 DESC, tau LIMIT 1""")
def best_threshold(spark, d) -> DataFrame:
    return evaluate.best_tau(P.threshold_sweep(spark, d))


@query(f"""WITH RECURSIVE {P._MATCHED}, street AS (SELECT entity_id, {R.STREET_NAME} AS street FROM norm), pr AS MATERIALIZED (SELECT s1, cand, {R.SORTED.format('a.street')} AS x, {R.SORTED.format('b.street')} AS y FROM matched JOIN street a ON a.entity_id = s1 JOIN street b ON b.entity_id = cand WHERE a.street <> '' AND b.street <> ''),
compare AS (SELECT DISTINCT x, y FROM pr), {R.lcs_sql('compare')} SELECT s1, cand FROM pr JOIN done USING (x, y) WHERE {R.INDEL} >= 70""")
def like_streets(spark, d) -> DataFrame:
    return filters.like_streets(P._matched(spark, d).select("s1", "cand"), features.prepare(R.normalized(spark, d)))


def _poisson(rate: float) -> list[float]:
    return evaluate.poisson_steps(rate)


@query(f"""WITH {P._SCORES}, e AS (SELECT s1, tp, n_true, n_pred + len(list_filter({_poisson(0.1)}, lambda c: c < CAST(('0x' || substr(md5(s1 || ':0'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)) AS m FROM scores),
f AS (SELECT CASE WHEN n_true = 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END WHEN m = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp::DOUBLE / m) * (tp::DOUBLE / n_true) / (0.25 * tp::DOUBLE / m + tp::DOUBLE / n_true) END AS f05 FROM e) SELECT round(avg(f05), 6) AS f05, count(*) AS entities FROM f""")
def noise_simulation(spark, d) -> DataFrame:
    return evaluate.simulate_noise(P._entity_scores(spark, d), 0.1)


@query(f"WITH {R.RECORDS}, {R.TRUTH}, {R.ENTITIES} SELECT e.s1, CASE WHEN count(t.cand) = 0 THEN 1 ELSE 0 END AS singleton FROM entities e LEFT JOIN truth t ON t.s1 = e.s1 GROUP BY e.s1")
def singletons(spark, d) -> DataFrame:
    return P._counts(spark, d).select("s1", (F.col("matches") == 0).cast("int").alias("singleton"))
