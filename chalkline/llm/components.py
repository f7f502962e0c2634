"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is joins and minimum aggregates over thin rows.  A node with very many
neighbours is pre-aggregated before the shuffle of its aggregate; in the join that brings
its least neighbour back its rows meet one row, and there the engine's run-time splitting
of skewed joins deals them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import only_last, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its least node.

    Rounds go on until the edges are stars around the least nodes; the loop only asks
    Spark for two sums a round.  No edges give no rows.
    """
    before = None
    with only_last(edges.sparkSession):
        now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
        for _ in range(rounds):
            now = written(_small_star(_large_star(now)), "edges")
            state = now.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
            ).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
