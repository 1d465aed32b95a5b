"""Connected components by randomised contraction.

In each round every node goes over to the member of its closed neighbourhood with the smallest hash, which
shrinks any graph by a constant factor on average, chains and stars alike. All steps are aggregations with
partial sums and equi-joins; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, written


def _rank(node: F.Column, turn: int) -> F.Column:
    return F.xxhash64(F.lit(turn), node)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); nodes have one root if and only if they are connected."""
    edges = written(edges.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    levels, turn = [], 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(_rank(F.col("b"), turn).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(_rank(F.col("a"), turn).alias("h"), F.col("a").alias("n"))
        step = written(best.select(F.col("a").alias("node"), F.least(own, F.col("m")).getField("n").alias("root")), "step")
        levels.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        next_edges = edges.join(left, "a").join(right, "b").where("ra <> rb")
        used, edges = edges, written(next_edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(used)
        turn += 1
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[-1]
    for step in reversed(levels[:-1]):
        upper = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = step.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found
