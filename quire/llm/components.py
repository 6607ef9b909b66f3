"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step replaces each node's links by links to the smallest node near it; edges never multiply, and after a number
of rounds that grows with the logarithm of the longest path every node links to the smallest of its component. Minima
are aggregated before the shuffle; where they are joined back to the edges, those of nodes of very many links go by
broadcast (join_counted), so such a node's edges stay where they are. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_shared, join_counted, materialize

#: Nodes of more links than this have their minimum broadcast.
HUB = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: bigint columns u, v. node and component (the smallest node reachable), for every node that an edge to
    another node has."""
    e = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e = materialize(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both, least, ["a"], "n", 2 * mark[0], HUB).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, down, ["a"], "n", 2 * mark[0], HUB).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(down.select("a", F.col("m").alias("b")))
        after = materialize(small.distinct(), "edges")
        drop_shared(e)
        e, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
