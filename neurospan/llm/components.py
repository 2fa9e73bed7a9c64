"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each neighbour at the smallest node around: larger neighbours (large star) or smaller ones (small star)."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:  # edges hold the larger node first
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "of")
    met = around.join(least, F.col("u") == F.col("of"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("of", "m"))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Nodes are integers.  Self loops, repeated edges and null ends are ignored; no edges give no rows.  Each round sends
    every edge once per star and is stored, so a lost executor costs one round.  Rounds grow with the logarithm of the
    longest path; not settling within ``rounds`` is an error, never a partial result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, mark = cut(edges), None
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
