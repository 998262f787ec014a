"""Connected components by alternating large and small stars, on written tables.

Each round hangs the neighbours of a node on the smallest of them; the number of
edges does not grow and hubs are summed before they are shuffled, so a chain of
n nodes ends after a few log(n) rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours (large: those above the node; else those below, and itself) on the smallest."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = sides.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str, v: str, write: Callable[[DataFrame, str], DataFrame] = write_table) -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node of its component."""
    current = write(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct(), "edges"
    )
    state = None
    while True:
        current = write(_star(_star(current, large=True), large=False), "stars")
        # Stable when nothing moves: each node hangs on one root and no root hangs on another.
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        summary = current.agg(F.count(F.lit(1)), total, F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(summary) == state:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = tuple(summary)
