"""Connected components by alternating large-star and small-star steps.

Each step replaces the edges by edges to a smaller neighbour: large-star links every
larger neighbour of a node to the smallest node around it, small-star does so for the
node and its smaller neighbours. Steps alternate until only stars are left; then every
node points at the smallest node of its component. The edges stay in tables; a hub's
minimum is a map-side aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, narrow


def _minima(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = _minima(down)
    linked = down.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(minima.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return open_.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge; ``edges``: u, v (longs).

    Edges of a node to itself count for nothing; an edge table without rows gives none.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, step = scratch.stage(down.distinct(), f"{name}_0"), 0
    now = narrow(now, now.count())
    while not _are_stars(now):
        step += 1
        now = scratch.stage(_small_star(_large_star(now)), f"{name}_{step}")
        now = narrow(now, now.count())
        scratch.drop(f"{name}_{step - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
