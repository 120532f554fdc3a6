"""Approximate nearest neighbours by collision counting over sorted projections.

Index: every vector is scaled to length one and projected on ``PROJECTIONS`` random
lines; per shard (one bounded block of vectors), each line keeps the projections as
one sorted array. Search: around the query's own projection, a window on every line
is widened by virtual rehashing (its half-width grows by ``GROWTH`` each round); a
vector that falls into the windows of enough lines (the collision threshold of the
round) is verified with its exact cosine. A query stops in a shard when its ``k``
best lie within the radius that the round stands for, or after the last round, which
verifies the ``SHARE`` of the shard with the most collisions at least.

Groups of identical vectors are searched as one class: only its ``k + 1`` smallest
ids can be among a query's ``k`` nearest, the query itself left out, so no more are
carried, and that loses nothing. Candidates are never capped.

The queries (a stated set) meet all shards in blocks of ``QUERY_BLOCK``: per block,
every shard returns its best ``k``, and the best of all shards are merged. A block is
all that is broadcast: QUERY_BLOCK vectors, whatever the number of queries.

Vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part. A null id takes no part. Repeated rows (same id
and vector) are one candidate. Fewer candidates than ``k``: all of them. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import Scratch

PROJECTIONS = 128
SEED = 42
#: First and last half-width of the windows on unit vectors, and the growth a round.
FIRST_WIDTH, LAST_WIDTH, GROWTH = 0.25, 1.0, 2.0
#: |N(0, 1)| is below this in three quarters of the cases; a collision threshold lies
#: MARGIN standard deviations of the count under three quarters of the lines.
QUARTILE, MARGIN = 1.1503, 2.0
#: The last round verifies this share of a shard at least, and LEAST rows, by count.
SHARE, LEAST = 0.08, 1_024
SHARD_ROWS = 8_192
QUERY_BLOCK = 8_192


def _usable(table: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


class Shard:
    """Sorted projections of one block of distinct vectors; ``ids`` holds the ids of each."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        self.raw, self.ids = vectors, ids
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        h = (vectors / self.norm[:, None]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(h, axis=0, kind="stable").astype(np.int32).T)
        self.sorted = np.ascontiguousarray(np.sort(h, axis=0).T)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
        """For each query, the ``k`` best (cosine, id) found in this shard, ties to the smaller id."""
        length = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / length[:, None]) @ self.lines
        widths = []
        width = FIRST_WIDTH
        while not widths or widths[-1] < LAST_WIDTH:
            widths.append(width)
            width *= GROWTH
        bounds = [
            tuple(
                np.array([np.searchsorted(self.sorted[j], at[:, j] + sign * w, side) for j in range(PROJECTIONS)]).T
                for sign, side in ((-1, "left"), (1, "right"))
            )
            for w in widths
        ]
        for q in range(len(queries)):
            yield self._search_one(queries[q], length[q], own[q], k, widths, [(lo[q], hi[q]) for lo, hi in bounds])

    def _search_one(self, query, length, own, k, widths, bounds) -> list[tuple[float, int]]:
        n = len(self.raw)
        counts = np.zeros(n, np.int64)
        verified = np.zeros(n, bool)
        best: list[tuple[float, int]] = []
        inner = None
        for r, (width, (lo, hi)) in enumerate(zip(widths, bounds)):
            if inner is None:
                parts = [line[a:b] for line, a, b in zip(self.order, lo, hi)]
            else:  # only the rings that the wider windows add
                parts = [line[a:b] for line, a, b in zip(self.order, lo, inner[0])]
                parts += [line[a:b] for line, a, b in zip(self.order, inner[1], hi)]
            inner = (lo, hi)
            counts += np.bincount(np.concatenate(parts), minlength=n)
            # A round stands for the radius at which a vector falls in three quarters of the windows.
            radius = width / QUARTILE
            threshold = PROJECTIONS * (0.75 - MARGIN * np.sqrt(0.75 * 0.25 / PROJECTIONS))
            if r == len(widths) - 1:  # and the last one verifies the best SHARE at least, equal counts together
                rank = n - 1 - min(n - 1, max(int(SHARE * n), LEAST) + k)
                threshold = min(threshold, np.partition(counts, rank)[rank])
            new = np.nonzero((counts >= threshold) & ~verified)[0]
            verified[new] = True
            score = (self.raw[new] * query).sum(axis=1) / (self.norm[new] * length)
            enough = np.argsort(-score, kind="stable")[: k + 1]
            floor = score[enough[-1]] if len(enough) else 0.0
            for s, row in zip(score, new):  # rows under the k + 1 best scores cannot be among the k nearest
                if s >= floor:
                    best += [(float(s), int(i)) for i in self.ids[row] if i != own]
            best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
            if len(best) == k and best[-1][0] >= 1 - radius * radius / 2:
                break
        return best


def _search_shard(shared, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, queries = shared.value
        shard = Shard(np.array(pdf["v"].tolist(), np.float64), pdf["ids"].tolist())
        out = [
            (int(own), i, s)
            for own, best in zip(ids, shard.search(queries, ids, k))
            for s, i in best
        ]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row with vec_id % every == 0."""
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = _usable(table)
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    dim = next((r["dim"] for r in common.collect()), 0)
    rows = rows.filter(F.size("v") == dim)

    # One row a distinct vector, with its k + 1 smallest ids. The rank limit works before
    # the shuffle too, so a vector that many rows share is k + 1 rows of each map task.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "v"]).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = scratch.stage(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)))

    queries = scratch.stage(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    marked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        block = marked.filter(F.col("block") == b).collect()
        shared = spark.sparkContext.broadcast((
            np.array([r["vec_id"] for r in block], np.int64),
            np.array([r["v"] for r in block], np.float64).reshape(len(block), dim),
        ))
        found = placed.groupBy("shard").applyInPandas(_search_shard(shared, k), "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    far = F.struct((-F.col("score")).alias("far"), "vec_id")
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(far)), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"),
    )
