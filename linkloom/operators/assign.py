"""One-to-one assignment: a candidate belongs to one entity."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_disjoint(ranked: DataFrame) -> DataFrame:
    """A candidate goes to the entity that ranks it best, then to the smaller entity id; nobody gets a replacement."""
    w = Window.partitionBy("cand").orderBy("rank", "s1")
    return ranked.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def checkpoints(spark) -> None:
    """Checkpoints go to the folder the cluster names; without one only local mode gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def release(spark) -> None:
    """Let Spark remove shuffle files, and checkpoints where it is told to, that no table refers to any more.

    Its cleaner learns of them when the driver's heap is collected, which a
    driver that does little else than plan seldom does by itself.  Tables that
    Python has dropped are still held by a queue of its bridge to the JVM, whose
    worker looks at it once a second, so that is waited for.
    """
    gc.collect()
    queue, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.monotonic() + 2
    while queue and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def greedy_bipartite(scored: DataFrame, tau: float = 0.0, cap: int = 6) -> DataFrame:
    """The greedy matching by p: an edge is taken if its candidate is free and its entity holds fewer than ``cap``.

    Edges have one order (p down, then s1, then cand).  In each round every
    edge is taken that is its candidate's best and within its entity's free
    places; what such edges exclude is dropped.  That gives what going through
    all edges one by one gives, in as many rounds as the longest chain of
    edges that wait for each other.  The first edge in order is taken in any
    round, so the loop ends by itself.  Each round is checkpointed.
    """
    checkpoints(scored.sparkSession)
    left = scored.filter(F.col("p") >= tau).select("s1", "cand", "p").checkpoint()
    taken, out = None, None
    of_cand = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
    of_s1 = Window.partitionBy("s1").orderBy(F.desc("p"), "cand")
    while not left.isEmpty():
        used = left.withColumn("used", F.lit(0)) if taken is None else left.join(taken, "s1", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        seen = used.withColumn("c", F.row_number().over(of_cand)).withColumn("e", F.row_number().over(of_s1))
        now = seen.filter((F.col("c") == 1) & (F.col("e") + F.col("used") <= cap)).select("s1", "cand", "p").checkpoint()
        out = now if out is None else out.union(now)
        counts = now.groupBy("s1").agg(F.count(F.lit(1)).cast("int").alias("used"))
        taken = (counts if taken is None else taken.union(counts)).groupBy("s1").agg(F.sum("used").cast("int").alias("used")).checkpoint()
        rest = left.join(now.select("cand"), "cand", "left_anti").join(taken.filter(F.col("used") >= cap), "s1", "left_anti")
        left = rest.select("s1", "cand", "p").checkpoint()
    return left if out is None else out


def collisions(matches: DataFrame) -> DataFrame:
    """Candidates that more than one entity claims, and the claims that must be wrong."""
    claims = matches.groupBy("cand").agg(F.countDistinct("s1").alias("claims")).filter("claims > 1")
    return claims.agg(F.count(F.lit(1)).alias("contested"), F.coalesce(F.sum(F.col("claims") - 1), F.lit(0)).alias("extra_claims"))
