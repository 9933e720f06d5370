"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyral.plans.skew import split_join
from gyral.session import cut, discard


#: Edges from which on the nodes with very many of them are looked for and joined apart.
HUB_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): each node's smallest node of its connected component.

    Large-star and small-star steps by turns, each an aggregation and a join, until nothing changes: rounds grow with
    the logarithm of the longest chain. Nodes with a large share of the edges, as roots have in the end, meet their one
    minimum by broadcast. Nulls and self-loops are ignored; no edges give no rows.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        met = split_join if seen and seen[0] >= HUB_EDGES else lambda left, right, key, how: left.join(right, key, how)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = met(both, least, "a", "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        before, now = now, cut(met(large, least, "a", "inner").select(F.explode(ends).alias("z")).select("z.*").filter("a <> b").distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
