"""Connected components of an undirected graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, stash


def _star(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """Link each node's neighbours (large: the greater ones; small: the lesser ones) to the least of them and it."""
    both = edges.select(F.col("u").alias("s"), F.col("v").alias("t")).unionByName(edges.select(F.col("v").alias("s"), F.col("u").alias("t")))
    if not large:
        both = both.where("t < s")
    # a written table on this side: the join then has an exchange on either side, and Spark can split a hub's rows
    least = stash(both.groupBy("s").agg(F.least(F.min("t"), F.first("s")).alias("m")), label)
    met = both.join(least, "s")
    if large:
        out = met.where("t > s").select(F.col("m").alias("u"), F.col("t").alias("v"))
    else:
        out = met.select(F.col("m").alias("u"), F.col("t").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("s").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v longs); component is the least node reachable.

    Edges may repeat, point either way or join a node to itself.  Every round moves edges by their
    nodes only; nothing is collected.  Ends when a round changes no edge.
    """
    now = stash(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    while before[0]:
        large = stash(_star(now, True, "large"), "edges")
        small = stash(_star(large, False, "small"), "edges")
        drop_stash(now)
        drop_stash(large)
        now, after = small, mark(small)
        if after == before:
            break
        before = after
    # every edge now joins a node to the least of its component
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
