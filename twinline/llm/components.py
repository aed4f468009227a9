"""Connected components of an edge table, by rounds of joins; no edge list reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stages import drop_stage, write_stage

FEW_EDGES = 100_000  # their least neighbours, two short keys an edge at most, are broadcast

def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node either hangs on one smaller node or has only larger ones hang on it; and the number of edges."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("below")), F.struct(F.col("b").alias("node"), F.lit(0).alias("below"))
    )).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max(1 - F.col("below")).alias("above"))
    bad, n = nodes.agg(F.count(F.when(F.col("below") + F.col("above") > 1, 1)), F.sum("below")).first()
    return bad == 0, n or 0


def _small_star(down: DataFrame, few: bool) -> DataFrame:
    """Smaller neighbours of a node hang on the smallest of them. Edges have ``b < a``; they may come twice."""
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(F.broadcast(low) if few else low, "a").select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))
    )).alias("e"))
    return hung.select("e.*").filter("a <> b").distinct()


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Neighbours above a node hang on the smallest node of its neighbourhood. Edges have ``b < a``."""
    both = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )).alias("e")).select("e.*")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Of an edge, the upper end hangs on the least neighbour of the lower one.
    return edges.join(F.broadcast(low) if few else low, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))


def stars(edges: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, str]:
    """``(a, b)``: every node of the edges but a component's smallest, with that smallest node; and the stage's path.

    Alternates the large-star and small-star steps until only stars are left; every round is
    written to the shared folder. A hub costs no more than its edges: stars are aggregates
    and joins, which Spark can split; least neighbours are broadcast when there are at most ``FEW_EDGES`` edges.
    No edges give an empty result.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    current, path = write_stage(down.distinct(), "edges")
    for _ in range(max_rounds):
        settled, n = _state(current)
        if settled:
            return current, path
        few = n <= FEW_EDGES
        following, next_path = write_stage(_small_star(_large_star(current, few), few), "edges")
        drop_stage(edges.sparkSession, path)
        current, path = following, next_path
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, comp)`` for every node of the edges ``(a, b)``; ``comp`` is its smallest node. See :func:`stars`."""
    current, _ = stars(edges, max_rounds)
    return current.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )
