"""Connected components of a graph given as edges, in rounds of equi-joins.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") replace edges until every node hangs on the smallest node of its component. Each
round is written to the shared folder, and the one before is deleted then. A node's smallest neighbour is found by an
aggregation that combines before the shuffle, and joined back, so that a node with a third of
all edges is a skewed join, which Spark splits, and never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import discard, stored


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")


def _large(edges: DataFrame) -> DataFrame:
    """Neighbours above a node get an edge to the smallest neighbour (or the node itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # for an edge a > b, seen from b, a is above
    return edges.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below get edges to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of an edge can reach.

    Edges have no direction; null ends, loops and repeats don't matter. A node whose edges
    are all loops is a component of its own. No edges give no rows.
    """
    kind = edges.schema[a].dataType.simpleString()
    given = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).filter("a is not null and b is not null")
    now = stored(_pairs(given).distinct(), "edges")
    loops = given.filter("a = b").select("a").distinct()
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or not seen["n"]:
            break
        mark, before = seen, now
        now = stored(_pairs(_small(_pairs(_large(now)).distinct())).distinct(), "edges")
        discard(before)
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return tied.unionAll(roots.unionAll(alone).distinct()).groupBy("node").agg(F.min("component").alias("component"))
