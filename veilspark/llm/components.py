"""Connected components of an edge table, by contraction: hook every root to its smallest neighbour, jump to the end of each chain, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.tables import written


def _ended(parent: DataFrame) -> DataFrame:
    """v, p with p the end of v's chain: doubling the jumps, so chains of n take log2(n) rounds."""
    while True:
        ends = parent.select(F.col("v").alias("w"), F.col("p").alias("q"))
        jumped = parent.join(ends, F.col("p") == F.col("w"), "left").select("v", F.coalesce("q", "p").alias("p"), (F.col("q").isNotNull() & (F.col("q") != F.col("p"))).alias("moved"))
        jumped = written(jumped, "jump")
        if jumped.where("moved").isEmpty():
            return jumped.select("v", "p")
        parent = jumped.select("v", "p")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex of its component, for every vertex that has an edge. Edges are a, b in any order, repeats allowed."""
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while not live.isEmpty():
        # Each vertex hooks to its smallest neighbour if that is smaller; parents are smaller, so there is no cycle.
        near = live.select(F.col("b").alias("v"), F.col("a").alias("p")).groupBy("v").agg(F.min("p").alias("p"))
        low = live.select(F.col("a").alias("v")).distinct().join(near, "v", "left_anti").select("v", F.col("v").alias("p"))
        parent = written(_ended(written(near.unionByName(low), "parents")), "parents")
        if roots is None:
            roots = parent.select("v", F.col("p").alias("root"))
        else:
            step = parent.select(F.col("v").alias("w"), "p")
            roots = roots.join(step, F.col("root") == F.col("w"), "left").select("v", F.coalesce("p", "root").alias("root"))
        roots = written(roots, "roots")
        ends = lambda side, to: parent.select(F.col("v").alias(f"{side}0"), F.col("p").alias(to))
        moved = live.join(ends("a", "ra"), F.col("a") == F.col("a0")).join(ends("b", "rb"), F.col("b") == F.col("b0")).where("ra <> rb")
        live = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots if roots is not None else live.select(F.col("a").alias("v"), F.col("b").alias("root"))
