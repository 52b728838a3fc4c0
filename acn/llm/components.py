"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregate over edges; hubs are met by map-side combine and adaptive skew joins, and each round is
written to the shared folder. Self loops and repeated edges are allowed; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each vertex's larger neighbours to the least vertex in its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each vertex and its smaller neighbours to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (vertex, root): each vertex that has an edge to another, other than the roots; root is the least vertex."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    state = None
    while True:
        figures = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(figures) == state or figures[0] == 0:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        state = tuple(figures)
        now = materialise(_small_star(_large_star(now)), name)
