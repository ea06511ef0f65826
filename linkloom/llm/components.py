"""Connected components of a link table, as a loop of small joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.text import release, with_checkpoints

#: Distinct links, 16 bytes each, that the driver follows itself; more are followed by joins.
AT_ONCE = 300_000
#: Parts that the links of one node are dealt to.
SALTS = 64


def _with_least(links: DataFrame, node: str, other: str) -> DataFrame:
    """``links`` with m, the least ``other`` of each ``node``.

    A node's links are dealt to parts by their other end, and only the parts
    meet: a node with very many links has no task of its own.
    """
    dealt = links.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(node, "salt").agg(F.min(other).alias("least"))
    whole = parts.groupBy(node).agg(F.min("least").alias("m"))
    back = parts.select(node, "salt").join(whole, node)
    return dealt.join(back, [node, "salt"]).select(node, other, "m")


def _followed(edges: DataFrame) -> DataFrame:
    """(node, root) by union and find over links that the driver holds; the smaller root stays."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    table = edges.toArrow()
    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
        root.setdefault(u, u)
        root.setdefault(v, v)
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    kind = table.schema.field("u").type
    found = pa.table({"node": pa.array(list(root), kind), "root": pa.array([find(x) for x in root], kind)})
    return edges.sparkSession.createDataFrame(found)


def components(links: DataFrame, a: str = "a", b: str = "b", at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) for each node of ``links``: the smallest node that it is linked to, over any path.

    Up to ``at_once`` distinct links are followed by the driver; more by joins,
    which give the same.  The joins alternate large-star and small-star steps (Kiveris et al., 2014) until
    the links no longer change, which they do after a number of rounds that
    grows with the logarithm of the nodes; every step is checkpointed, the files
    of the step before are released, and nothing but a count reaches the driver.
    """
    spark = links.sparkSession
    with_checkpoints(spark)
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    if edges.count() <= at_once:
        return _followed(edges)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before, now = None, (0, 0)
    while before != now:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every node's larger neighbours point to the least of its neighbourhood
        large = _with_least(both, "u", "v").filter("v > u").select(F.least("u", "m").alias("y"), F.col("v").alias("x")).filter("x <> y").distinct()
        # small star: the smaller neighbours and the node itself point to the least of them
        down = _with_least(large, "x", "y")
        small = down.select(F.col("m").alias("u"), F.col("y").alias("v")).union(down.select(F.col("m").alias("u"), F.col("x").alias("v")))
        edges = small.filter("u <> v").distinct().checkpoint()
        before, now = now, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        del both, large, down, small
        release(spark)
    return nodes.join(edges.select(F.col("v").alias("node"), F.col("u").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
