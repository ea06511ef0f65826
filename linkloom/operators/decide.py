"""Decision rules: which of an entity's scored candidates are matches.

A rule takes rows (s1, cand, p) and gives those it accepts with their rank;
all order by p, ties by id.  Rules are windows over an entity's candidates,
which blocking has bounded, so none needs a loop or a second pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.operators import assign


def _by_p() -> Window:
    return Window.partitionBy("s1").orderBy(F.desc("p"), "cand")


def _running() -> Window:
    return _by_p().rowsBetween(Window.unboundedPreceding, 0)


def ranked(scored: DataFrame) -> DataFrame:
    """With the rank from 1 and the entity's best p."""
    return scored.withColumn("rank", F.row_number().over(_by_p())).withColumn("p1", F.first("p").over(_by_p()))


def _take(df: DataFrame, accept: Column, cap: int | None = None) -> DataFrame:
    """Accepted rows, renumbered; ``cap`` of them at most."""
    kept = df.filter(accept).withColumn("rank", F.row_number().over(_by_p()))
    return (kept if cap is None else kept.filter(F.col("rank") <= cap)).select("s1", "cand", "p", "rank")


def fixed_tau(scored: DataFrame, tau: float = 0.75, cap: int | None = 10) -> DataFrame:
    return _take(scored, F.col("p") >= tau, cap)


def country_tau(scored: DataFrame, taus: dict[str, float], default: float, cap: int | None = None) -> DataFrame:
    """A threshold for each country, with one for all others; rows carry ``country``."""
    table = F.create_map(*[F.lit(x) for pair in taus.items() for x in pair])
    return _take(scored, F.col("p") >= F.coalesce(F.try_element_at(table, F.col("country")), F.lit(default)), cap)


def dynamic_margin(scored: DataFrame, least: float = 0.75, delta: float = 0.08, cap: int | None = 6) -> DataFrame:
    """At least ``least``, and within ``delta`` of the best."""
    return _take(ranked(scored), (F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= delta), cap)


def scaled_margin(scored: DataFrame, least: float = 0.75, share: float = 0.06, cap: int | None = 6) -> DataFrame:
    return _take(ranked(scored), (F.col("p") >= least) & (F.round(F.col("p1") - F.col("p") - share * F.col("p1"), 9) <= 0), cap)


def probability_ratio(scored: DataFrame, least: float = 0.75, share: float = 0.92, cap: int | None = 6) -> DataFrame:
    return _take(ranked(scored), (F.col("p") >= least) & (F.round(F.col("p") - share * F.col("p1"), 9) >= 0), cap)


def cliff(scored: DataFrame, least: float = 0.75, gap: float = 0.08, cap: int | None = 6) -> DataFrame:
    """Down to the first fall between neighbours of over ``gap``; the density rule is the same with 0.06."""
    df = ranked(scored.filter(F.col("p") >= least))
    fall = F.coalesce(F.round(F.lag("p").over(_by_p()) - F.col("p"), 9) > gap, F.lit(False))
    df = df.withColumn("fall", fall.cast("int"))
    return _take(df.withColumn("falls", F.sum("fall").over(_running())), F.col("falls") == 0, cap)


def gap_cut(scored: DataFrame, least: float = 0.75, least_gap: float = 0.05, otherwise: int = 4, cap: int | None = 10) -> DataFrame:
    """Down to the largest fall, the first of equal ones, if it is ``least_gap`` or more; else the first few."""
    df = ranked(scored.filter(F.col("p") >= least)).withColumn("gap", F.round(F.col("p") - F.lead("p").over(_by_p()), 9))
    whole = Window.partitionBy("s1")
    best = F.max(F.struct(F.coalesce("gap", F.lit(-1.0)).alias("gap"), (-F.col("rank")).alias("back"))).over(whole)
    df = df.withColumn("best", best)
    cut = F.when(F.col("best.gap") >= least_gap, -F.col("best.back")).otherwise(otherwise)
    return _take(df, F.col("rank") <= cut, cap)


def softmax_mass(scored: DataFrame, least: float = 0.75, temperature: float = 0.15, mass: float = 0.88, cap: int | None = 6) -> DataFrame:
    """Of those of at least ``least``, the best, and others while the mass so far, their own included, is at most ``mass``."""
    df = ranked(scored.filter(F.col("p") >= least)).withColumn("e", F.exp((F.col("p") - F.col("p1")) / temperature))
    share = F.sum("e").over(_running()) / F.sum("e").over(Window.partitionBy("s1"))
    return _take(df.withColumn("share", F.round(share, 9)), (F.col("rank") == 1) | (F.col("share") <= mass), cap)


def rank_adaptive(scored: DataFrame, first: float = 0.5, others: float = 0.7, gap: float = 0.35, cap: int | None = 10) -> DataFrame:
    """One bar for the best candidate and another, with a limit on the distance to it, for the rest."""
    rest = (F.col("rank") > 1) & (F.col("p") >= others) & (F.round(F.col("p1") - F.col("p"), 9) <= gap)
    return _take(ranked(scored), ((F.col("rank") == 1) & (F.col("p") >= first)) | rest, cap)


def _with_top(df: DataFrame, text: str) -> DataFrame:
    """With the best candidate's text beside each row's own."""
    return ranked(df).withColumn("top_text", F.first(text).over(_by_p()))


def two_stage_consensus(scored: DataFrame, text: str = "cand_name", least: float = 0.75, delta: float = 0.08, cut: float = 45.0, cap: int | None = 6) -> DataFrame:
    """The margin rule, and a name like the best candidate's; with a core stem as ``text`` it is the core-stem rule."""
    df = _with_top(scored, text).filter((F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= delta))
    return _take(df.withColumn("like", S.similarities(F.col("top_text"), F.col(text), "token_sort")["token_sort"]), F.col("like") >= cut, cap)


def triplet_consensus(scored: DataFrame, least: float = 0.75, delta: float = 0.08, own: float = 40.0, top: float = 45.0, cap: int | None = 6) -> DataFrame:
    """The margin rule, and for all but the best candidate a name like the entity's and like the best one's; rows carry s1_name and cand_name."""
    df = _with_top(scored, "cand_name").filter((F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= delta))
    like = lambda a, b: S.similarities(F.col(a), F.col(b), "token_sort")["token_sort"]
    return _take(df.withColumns({"x": like("s1_name", "cand_name"), "y": like("top_text", "cand_name")}), (F.col("rank") == 1) | ((F.col("x") >= own) & (F.col("y") >= top)), cap)


def hybrid_guard(scored: DataFrame, least: float = 0.75, delta: float = 0.08, top: float = 45.0, cap: int | None = 6) -> DataFrame:
    """The margin rule without pairs of unlike names at one address (name_sim, addr_sim), and a name like the best candidate's."""
    df = _with_top(scored, "cand_name").filter((F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= delta) & ~guard_d())
    return _take(df.withColumn("like", S.similarities(F.col("top_text"), F.col("cand_name"), "token_sort")["token_sort"]), F.col("like") >= top, cap)


def disambiguate(scored: DataFrame, least: float = 0.65, sim: float = 45.0, gap: float = 0.08, text: str = "cand_name", cap: int | None = 10) -> DataFrame:
    """Drops later candidates whose name is unlike the best one's and whose p is far from its."""
    df = _with_top(scored.filter(F.col("p") >= least), text).withColumn("like", S.similarities(F.col("top_text"), F.col(text), "token_sort")["token_sort"])
    return _take(df, ~((F.col("rank") > 1) & (F.col("like") < sim) & (F.round(F.col("p1") - F.col("p"), 9) > gap)), cap)


def feature_augmented(scored: DataFrame, least: float = 0.75, name: float = 45.0, cap: int | None = 6) -> DataFrame:
    return _take(scored, (F.col("p") >= least) & (F.col("name_sim") >= name), cap)


def guard_d(name: float = 45.0, addr: float = 70.0) -> Column:
    """Unlike names at a like address; similarities from 0 to 100."""
    return (F.col("name_sim") < name) & (F.col("addr_sim") > addr)


#: Raised bars for pairs of unlike names: (name similarity below, p at least), and the bar for all.
NAME_BARS = {"A": ((50.0, 0.90),), "B": ((55.0, 0.92),), "C": ((50.0, 0.92),)}


def name_bars(scored: DataFrame, which: str, tau: float = 0.75) -> DataFrame:
    """Guards A, B and C, where an unlike name needs a higher p, and D."""
    if which == "D":
        return _take(scored, (F.col("p") >= tau) & ~guard_d())
    need = F.lit(0.80 if which == "C" else tau)
    for below, bar in NAME_BARS[which]:
        need = F.when(F.col("name_sim") < below, bar).otherwise(need)
    return _take(scored, F.col("p") >= need)


def production(scored: DataFrame, guarded: tuple[str, ...] = ("France",), least: float = 0.75) -> DataFrame:
    """The dynamic margin with guard D in some countries; a guarded best candidate still sets the margin."""
    df = ranked(scored)
    inside = (F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= 0.08)
    return _take(df, inside & ~(F.col("country").isin(list(guarded)) & guard_d()), 6)


def synthesis_edges(scored: DataFrame, least: float = 0.75, delta: float = 0.08, gap: float = 0.07, cap: int = 5) -> DataFrame:
    """Margin, guard D and a cliff: a row must be within ``gap`` of the last accepted p, at first the best p, guarded or not.

    Guarded rows are passed over and don't move the last accepted p.  What is
    accepted depends on what was accepted before, so an entity's bounded
    candidates are folded in order.
    """
    df = ranked(scored).filter((F.col("p") >= least) & (F.round(F.col("p1") - F.col("p"), 9) <= delta)).withColumn("bad", guard_d())
    lists = df.groupBy("s1").agg(F.max("p1").alias("p1"), F.array_sort(F.collect_list(F.struct("rank", "cand", "p", "bad"))).alias("x"))
    none = F.array().cast("array<struct<cand:string,p:double>>")
    start = F.struct(none.alias("out"), F.col("p1").alias("last"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["done"] | (F.round(acc["last"] - x["p"], 9) > gap)
        grown = F.struct(F.concat(acc["out"], F.array(F.struct(x["cand"].alias("cand"), x["p"].alias("p")))).alias("out"), x["p"].alias("last"), F.lit(False).alias("done"))
        return F.when(stop, F.struct(acc["out"].alias("out"), acc["last"].alias("last"), F.lit(True).alias("done"))).when(x["bad"], acc).otherwise(grown)

    folded = lists.select("s1", F.posexplode(F.slice(F.aggregate("x", start, step, lambda a: a["out"]), 1, cap)).alias("i", "m"))
    return folded.select("s1", "m.cand", "m.p", (F.col("i") + 1).alias("rank"))


def grand_synthesis(scored: DataFrame, least: float = 0.75, delta: float = 0.08, gap: float = 0.07, cap: int = 5) -> DataFrame:
    """The edges of :func:`synthesis_edges`, each candidate then given to one entity by the greedy matching."""
    edges = synthesis_edges(scored, least, delta, gap, cap)
    return _take(assign.greedy_bipartite(edges, 0.0, cap), F.lit(True))


#: Thresholds of the rule chain: the least name similarity beside a strong address, the least solo name, the least solo address.
ANCHOR = {"France": (48.0, 74.0, 75.0), "US": (35.0, 74.0, 72.0), "India": (35.0, 74.0, 72.0)}
ANCHOR_DEFAULT = (35.0, 74.0, 72.0)


def dual_anchor(pairs: DataFrame) -> DataFrame:
    """A chain of rules without a model; adds ``rule`` (the first that holds, null if none) and ``composite``.

    Rows carry country, name_set, name_sort, addr_set (0 to 100), conflict,
    number_match and address_missing.
    """
    by = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in ANCHOR.items() for x in (c, v[i])]), F.col("country")), F.lit(ANCHOR_DEFAULT[i]))
    n, s, a, clear = F.col("name_set"), F.col("name_sort"), F.col("addr_set"), ~F.col("conflict")
    composite = F.greatest(n, a) + F.lit(0.3) * F.least(n, a)
    rule = (
        F.when((n >= 70) & (a >= 55) & clear, 1)
        .when(F.col("number_match") & (a >= 65) & (n >= 30) & clear, 2)
        .when((a >= by(2)) & (n >= by(0)) & clear, 3)
        .when((s >= by(1)) & (F.col("address_missing") | ((a >= 45) & clear)), 4)
        .when((s >= 60) & (a >= 48) & (composite >= 105) & clear, 5)
    )
    return pairs.withColumn("composite", composite).withColumn("rule", rule)


def rule_grid(pairs: DataFrame, names: list[float], addrs: list[float], ps: list[float] = [0.0]) -> DataFrame:
    """name_cut, addr_cut, p_cut, accepted and true pairs for each point of a grid, in one pass; rows carry name_sim, addr_sim, p and hit.

    A pair falls in one cell of the grid, the last cuts that it reaches; cells
    are counted, and a point's counts are the sums of the cells at or above it.
    """
    last = lambda value, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))
    cells = pairs.groupBy(last(F.col("name_sim"), names).alias("i"), last(F.col("addr_sim"), addrs).alias("j"), last(F.col("p"), ps).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    points = [(float(x), float(y), float(z), i, j, k) for i, x in enumerate(names, 1) for j, y in enumerate(addrs, 1) for k, z in enumerate(ps, 1)]
    grid = pairs.sparkSession.createDataFrame(points, "name_cut double, addr_cut double, p_cut double, gi int, gj int, gk int")
    sums = F.broadcast(grid).join(cells, (F.col("i") >= F.col("gi")) & (F.col("j") >= F.col("gj")) & (F.col("k") >= F.col("gk")), "left")
    return sums.groupBy("name_cut", "addr_cut", "p_cut").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("h"), F.lit(0)).alias("correct"))


def ensemble(kind: str, *ps: str, weights: tuple[float, ...] | None = None) -> Column:
    """Mean, weighted mean, max or min of several models' probabilities."""
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(*ps)
    weights = weights or (1 / len(ps),) * len(ps)
    return sum((w * F.col(p) for w, p in zip(weights[1:], ps[1:])), weights[0] * F.col(ps[0]))


#: The rules that need no more than (s1, cand, p).
RULES: dict[str, Callable[..., DataFrame]] = {
    "fixed_tau": fixed_tau, "dynamic_margin": dynamic_margin, "scaled_margin": scaled_margin, "ratio": probability_ratio, "cliff": cliff,
    "gap_cut": gap_cut, "softmax_mass": softmax_mass, "rank_adaptive": rank_adaptive,
}
