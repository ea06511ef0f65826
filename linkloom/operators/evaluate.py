"""Metrics of matches and of probabilities.

Truth and predictions are edge tables (s1, cand) beside an entity table that
holds every S1 entity, so entities without edges count.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import assign, sampling

BETA2 = 0.25


def f_beta(p: Column, r: Column) -> Column:
    """F0.5 of a precision and a recall; 0 where both are."""
    return F.when(BETA2 * p + r == 0, 0.0).otherwise((1 + BETA2) * p * r / (BETA2 * p + r))


def set_f05(truth: Column, pred: Column) -> Column:
    """A struct of f05, precision and recall of two id arrays, with the rules for entities without matches."""
    tp, n, m = F.size(F.array_intersect(truth, pred)), F.size(F.array_distinct(truth)), F.size(F.array_distinct(pred))
    return _scores(tp, n, m)


def _scores(tp: Column, n: Column, m: Column) -> Column:
    p = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(tp / F.greatest(m, F.lit(1)))
    r = F.when(n == 0, 1.0).when(m == 0, 0.0).otherwise(tp / F.greatest(n, F.lit(1)))
    f = F.when(n == 0, F.when(m == 0, 1.0).otherwise(0.0)).otherwise(f_beta(p, r))
    return F.struct(f.cast("double").alias("f05"), p.cast("double").alias("precision"), r.cast("double").alias("recall"))


def entity_scores(entities: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """s1, n_true, n_pred, tp, f05, precision and recall for each entity: one shuffle of both edge tables by pair, one by entity."""
    marked = truth.select("s1", "cand", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(pred.select("s1", "cand", F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = marked.groupBy("s1", "cand").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    sums = pairs.groupBy("s1").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    return _of_sums(entities.select("s1").join(sums, "s1", "left"))


def judged_scores(entities: DataFrame, true_counts: DataFrame, pred: DataFrame) -> DataFrame:
    """The same from true_counts (s1, n_true) and pred (s1, cand, same), each pair once, ``same`` 1 for a true one.

    No table of true pairs is made, which grows with the square of a group of copies.
    """
    sums = pred.groupBy("s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("same").alias("tp"))
    return _of_sums(entities.select("s1").join(true_counts, "s1", "left").join(sums, "s1", "left"))


def _of_sums(df: DataFrame) -> DataFrame:
    df = df.na.fill(0, ["n_true", "n_pred", "tp"])
    return df.withColumn("_s", _scores(F.col("tp"), F.col("n_true"), F.col("n_pred"))).select("s1", "n_true", "n_pred", "tp", "_s.*")


def macro(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return scores.agg(F.count(F.lit(1)).alias("entities"), mean("f05"), mean("precision"), mean("recall"))


def micro(scores: DataFrame) -> DataFrame:
    """F0.5 over all pairs at once."""
    s = scores.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"))
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_true", F.lit(1))
    return s.select("tp", "n_pred", "n_true", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r), 6).alias("f05"))


def oracle_bound(entities: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores of a classifier that never errs on the candidates it gets."""
    return entity_scores(entities, truth, truth.join(candidates, ["s1", "cand"], "left_semi"))


def match_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy("s1").agg(F.count(F.lit(1)).alias("matches"))
    return entities.join(n, "s1", "left").na.fill(0, ["matches"])


def histogram(counts: DataFrame) -> DataFrame:
    """matches, entities and their share, and the entities with as many or fewer; the running sum is over a row for each count."""
    h = counts.groupBy("matches").agg(F.count(F.lit(1)).alias("entities"))
    through = Window.orderBy("matches").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    return h.withColumn("through", F.sum("entities").over(through)).withColumn("pct", F.round(100 * F.col("entities") / F.sum("entities").over(whole), 6))


def cluster_sizes(counts: DataFrame, by: list[str], cap: int = 12) -> DataFrame:
    """Sizes of entities' match sets: mean, exact percentiles, largest, and what a cap would lose."""
    some = F.when(F.col("matches") > 0, F.col("matches"))
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), F.count(some).alias("matched"), F.sum("matches").alias("pairs"), F.round(F.coalesce(F.avg(some), F.lit(0.0)), 6).alias("mean"),
        F.round(F.coalesce(F.percentile(some, 0.5), F.lit(0.0)), 6).alias("median"), F.round(F.coalesce(F.percentile(some, 0.95), F.lit(0.0)), 6).alias("p95"), F.round(F.coalesce(F.percentile(some, 0.99), F.lit(0.0)), 6).alias("p99"), F.max("matches").alias("largest"),
        F.count_if(F.col("matches") > cap).alias("over_cap"), F.sum(F.greatest(F.lit(0), F.col("matches") - cap)).alias("pairs_lost"),
    )


def confidence(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """Matches, least and mean p and a tier for each entity (s1, country); one without matches is sure."""
    a = accepted.groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("min_p"), F.avg("p").alias("mean_p"))
    df = entities.join(a, "s1", "left").na.fill(0, ["n"]).na.fill(0.0, ["min_p", "mean_p"])
    return df.withColumn("tier", tier(F.col("country"), F.col("min_p"), F.col("n")))


#: Least p of the tiers High and Medium; countries without a row have the default's.
TIERS = {"France": (0.9990, 0.9970)}
TIERS_DEFAULT = (0.9500, 0.9150)


def tier(country: Column, least: Column, n: Column) -> Column:
    high, medium = (F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in TIERS.items() for x in (c, v[i])]), country), F.lit(TIERS_DEFAULT[i])) for i in (0, 1))
    return F.when((n == 0) | (least >= high), "High").when(least >= medium, "Medium").otherwise("Low")


def tier_metrics(rated: DataFrame) -> DataFrame:
    """Pair precision and exact-set share of each tier; rows carry tier, n_true, n_pred, tp."""
    exact = (F.col("tp") == F.col("n_true")) & (F.col("tp") == F.col("n_pred"))
    return rated.groupBy("tier").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n_pred") > 0).alias("matched"), F.sum("n_pred").alias("pairs"), F.sum("tp").alias("true_pairs"),
        F.round(F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1)), 6).alias("precision"), F.round(F.avg(exact.cast("double")), 6).alias("exact"),
    )


#: Edges of the reliability bins; the last bin is closed, so that p = 1 is in one.
BINS = (0.80, 0.85, 0.90, 0.92, 0.94, 0.96, 0.98, 1.00)


def reliability(pairs: DataFrame, bins: tuple[float, ...] = BINS) -> DataFrame:
    """low, n, mean p and true share of each bin of pairs (p, label)."""
    low = F.array_max(F.filter(F.array(*map(F.lit, bins[:-1])), lambda b: b <= F.col("p")))
    inside = pairs.filter((F.col("p") >= bins[0]) & (F.col("p") <= bins[-1])).withColumn("low", low)
    return inside.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("label"), 6).alias("share"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error: the bins' gaps weighed by their sizes."""
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def brier(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col("p") - F.col("label")) ** 2), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


def wilson(p: Column, n: Column, z: float = 1.96) -> Column:
    """The Wilson interval of a share as a struct (low, high); (0, 0) of nothing."""
    m = F.greatest(n.cast("double"), F.lit(1e-9))
    middle, bottom = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(F.greatest(p * (1 - p) / m + z * z / (4 * m * m), F.lit(0.0)))
    low, high = F.greatest(F.lit(0.0), (middle - half) / bottom), F.least(F.lit(1.0), (middle + half) / bottom)
    return F.struct(F.when(n == 0, 0.0).otherwise(low).alias("low"), F.when(n == 0, 0.0).otherwise(high).alias("high"))


# Calibrated shares of false pairs, (strict, conservative), among flagged and among clean pairs.
FALSE_FLAGGED = {"France": (0.800, 1.000), "US": (0.900, 0.900), "India": (0.778, 1.000)}
FALSE_CLEAN = {"France": (0.000, 0.255), "US": (0.000, 0.040), "India": (0.000, 0.238)}
#: Other countries get the mean of the known ones.
FALSE_DEFAULT = ((0.826, 0.967), (0.0, 0.178))


def total_precision(flagged: DataFrame) -> DataFrame:
    """Precision by the law of total probability, for rows (country, flagged)."""
    share = flagged.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("flagged").cast("double")).alias("f"))

    def rate(table: dict, default: tuple, i: int) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in table.items() for x in (c, v[i])]), F.col("country")), F.lit(default[i]))

    precision = lambda i: F.round(1 - (F.col("f") * rate(FALSE_FLAGGED, FALSE_DEFAULT[0], i) + (1 - F.col("f")) * rate(FALSE_CLEAN, FALSE_DEFAULT[1], i)), 6)
    return share.select("country", "pairs", F.round("f", 6).alias("flagged_share"), precision(0).alias("strict"), precision(1).alias("conservative"))


def sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame, taus: list[float]) -> DataFrame:
    """tau and macro F0.5 for each threshold, in one pass.

    An entity's counts at every threshold are conditional sums over its pairs,
    so pairs are not repeated for each threshold; ``truth`` may hold pairs
    that were never scored.
    """
    rows = scored.select("s1", "cand", "p").join(truth.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "full")
    per = rows.groupBy("s1").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("n"), *[F.struct(F.count_if(F.col("p") >= t).alias("m"), F.count_if((F.col("p") >= t) & (F.col("hit") == 1)).alias("tp")).alias(f"t{i}") for i, t in enumerate(taus)])
    df = entities.select("s1").join(per, "s1", "left").na.fill(0, ["n"])
    get = lambda i, f: F.coalesce(F.col(f"t{i}.{f}"), F.lit(0))
    means = df.agg(*[F.avg(_scores(get(i, "tp"), F.col("n"), get(i, "m"))["f05"]).alias(f"t{i}") for i in range(len(taus))])
    return means.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(F.col(f"t{i}"), 6).alias("f05")) for i, t in enumerate(taus)])))


def best_tau(swept: DataFrame) -> DataFrame:
    """The threshold of the best score, the smallest of equal ones."""
    best = F.max(F.struct("f05", (-F.col("tau")).alias("back")))
    return swept.agg(best.alias("b")).select((-F.col("b.back")).alias("tau"), F.col("b.f05").alias("f05"))


def bipartite_grid(scored: DataFrame, truth: DataFrame, entities: DataFrame, taus: list[float], caps: list[int]) -> DataFrame:
    """tau, cap, f05 and mean matches of the greedy matching at each point of a grid.

    The matching takes edges from the best p down, so the one at a higher
    threshold is the start of the one at a lower: it is made once for each cap.
    """
    parts = []
    for cap in caps:
        matched = assign.greedy_bipartite(scored, min(taus), cap)
        f05 = sweep(matched, truth, entities, taus)
        size = entities.agg(F.count(F.lit(1)).alias("n")).crossJoin(matched.agg(*[F.count_if(F.col("p") >= t).alias(f"m{i}") for i, t in enumerate(taus)]))
        means = size.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(F.col(f"m{i}") / F.col("n"), 6).alias("matches")) for i, t in enumerate(taus)])))
        parts.append(f05.join(means, "tau").select("tau", F.lit(cap).alias("cap"), "f05", "matches"))
    return reduce(DataFrame.unionByName, parts)


def best_point(grid: DataFrame) -> DataFrame:
    """The point of the best score; of equal ones the least threshold, then the least cap."""
    best = F.max(F.struct("f05", (-F.col("tau")).alias("t"), (-F.col("cap")).alias("c"), "matches"))
    return grid.agg(best.alias("b")).select((-F.col("b.t")).alias("tau"), (-F.col("b.c")).alias("cap"), F.col("b.f05").alias("f05"), F.col("b.matches").alias("matches"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties.

    Values are counted first; the running sum that ranks them goes over
    ranges of values, each range in a task of its own, with the rows before
    it known from the ranges' counts.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(F.col(c)).withColumn("part", F.spark_partition_id())
        counts = counts.checkpoint()
        parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
        before = parts.alias("a").join(parts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("before"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rank = F.col("before") + within + (F.col("n") + 1) / 2.0
        return counts.join(F.broadcast(before), "part").select(c, rank.alias(f"r{c}"))

    assign.checkpoints(df.sparkSession)
    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def match_rate(counts: DataFrame) -> DataFrame:
    return counts.groupBy("country").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("matches") > 0).alias("matched"), F.round(F.avg((F.col("matches") > 0).cast("double")), 6).alias("rate"))


def truncation_stats(counts: DataFrame, k: int) -> DataFrame:
    """Pairs kept and lost by keeping k of each entity's, per country."""
    kept = F.least(F.col("matches"), F.lit(k))
    return counts.groupBy("country").agg(F.sum("matches").alias("pairs"), F.sum(kept).alias("kept"), F.round(1 - F.sum(kept) / F.greatest(F.sum("matches"), F.lit(1)), 6).alias("reduction"))


def poisson_steps(rate: float) -> list[float]:
    """The distribution function of a Poisson number at 0, 1, 2, ..., as far as a draw of 32 bits can tell."""
    steps, term, total, k = [], math.exp(-rate), 0.0, 0
    while total < 1 - 2.0**-33 and term > 0:
        total += term
        steps.append(total)
        k += 1
        term *= rate / k
    return steps


def simulate_noise(scores: DataFrame, extra_rate: float, seed: int = 0) -> DataFrame:
    """Macro F0.5 if every entity got a Poisson number of wrong matches; the draw is a function of the id and the seed."""
    u = sampling.draw(F.col("s1"), seed) / 4294967296.0
    extra = F.size(F.filter(F.array(*map(F.lit, poisson_steps(extra_rate))), lambda c: c < u))
    noisy = scores.withColumn("_s", _scores(F.col("tp"), F.col("n_true"), F.col("n_pred") + extra))
    return noisy.agg(F.round(F.avg("_s.f05"), 6).alias("f05"), F.count(F.lit(1)).alias("entities"))
