"""Centroid clustering (Lloyd's rounds in integers), centroids filtered by N-simplex projection.

Vectors of exactly ``dim`` components, none null or non-finite, become integers
``floor(scale * x)``. The first centroids are the ``k`` vectors whose ``seed:vec_id`` has
the smallest SHA-256. Each round gives every vector to the nearest centroid (squared
Euclidean distance, ties to the smaller number) and moves each centroid that has
vectors to the floor of their mean; then the vectors are assigned once more.

Filter: the distances of a vector to a few pivots (the first centroids, as far as they
are independent) are computed once. The pivots span a simplex; a vector's distances to
them give an apex over it, one coordinate a pivot, which is stored beside the vector in
a staged table. The Euclidean distance of two apexes is a lower bound of the distance of
the vectors, and that with one altitude turned over an upper bound. Per round only the
pivots' distances of the ``k`` centroids are new; a centroid whose lower bound is over a
vector's least upper bound is out, and the exact integer distance decides among the
others. Bounds are taken with a margin far over their rounding error.

The vectors never move: a round is one map over the staged table that sums vectors per
centroid within a task, and an aggregate of ``k * (dim + 1)`` numbers a task; only the
``k`` centroids pass through the driver.

Rows with one vec_id count as often as they occur; a null vec_id takes part, its hash is
that of ``seed:``, and comes back null. Equal hashes are ordered by the vectors. Fewer
vectors than ``k`` make as many centroids as there are vectors; none give no rows. Extra
columns are ignored. Distances are longs: a component of ``2**27`` or more, scaled, is an
error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import Scratch

CLUSTERS, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, 1
PIVOTS = 8
#: A pivot nearer to the others' span than this share of its distance adds nothing but rounding error.
FLAT = 1e-3
#: Bounds are widened by this share of the distances they come from.
MARGIN = 1e-7
LARGEST = 1 << 27
_BLOCK = 4_096


class Simplex:
    """The pivots, their base simplex, and the apex of any vector over it."""

    def __init__(self, candidates: np.ndarray, pivots: int):
        """Takes up to ``pivots`` of the candidates (int64 rows), in order, that are not in the others' span."""
        chosen: list[int] = []
        for i in range(len(candidates)):
            if len(chosen) == pivots:
                break
            edges = (candidates[chosen + [i]] - candidates[(chosen + [i])[0]])[1:].astype(np.float64)
            if not chosen or self._altitude(edges) > FLAT * np.linalg.norm(edges[-1]):
                chosen.append(i)
        self.pivots = candidates[chosen]
        edges = (self.pivots[1:] - self.pivots[:1]).astype(np.float64)
        base = np.linalg.cholesky(edges @ edges.T) if len(edges) else np.zeros((0, 0))
        self.to_base = np.linalg.inv(base).T if len(edges) else base
        self.norms = (edges * edges).sum(axis=1)

    @staticmethod
    def _altitude(edges: np.ndarray) -> float:
        """Distance of the last point from the span of the others (all seen from the first)."""
        if len(edges) == 1:
            return float(np.linalg.norm(edges[0]))
        inside = np.linalg.lstsq(edges[:-1].T, edges[-1], rcond=None)[0]
        return float(np.linalg.norm(edges[-1] - inside @ edges[:-1]))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of coordinates a vector: those in the pivots' span, and the altitude."""
        squares = np.empty((len(vectors), len(self.pivots)))
        for j, pivot in enumerate(self.pivots):
            away = vectors - pivot
            squares[:, j] = np.einsum("ij,ij->i", away, away)
        inside = (squares[:, :1] + self.norms - squares[:, 1:]) / 2 @ self.to_base
        height = np.sqrt(np.maximum(squares[:, 0] - (inside * inside).sum(axis=1), 0))
        return np.concatenate((inside, height[:, None]), axis=1)


def nearest(
    vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance) of each vector, and how many distances were computed.

    ``centres`` are the centroids' apexes.
    """
    cluster, distance, computed = [], [], 0
    reach = np.sqrt((centres * centres).sum(axis=1))
    for at in range(0, len(vectors), _BLOCK):
        block, apex = vectors[at : at + _BLOCK], apexes[at : at + _BLOCK]
        level = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
        lower = np.sqrt(level + (apex[:, None, -1] - centres[None, :, -1]) ** 2)
        upper = np.sqrt(level + (apex[:, None, -1] + centres[None, :, -1]) ** 2)
        slack = MARGIN * (np.sqrt((apex * apex).sum(axis=1))[:, None] + reach + 1)
        rows, columns = np.nonzero(lower - slack <= (upper + slack).min(axis=1)[:, None])
        exact = np.full((len(block), len(centroids)), np.iinfo(np.int64).max)
        away = block[rows] - centroids[columns]
        exact[rows, columns] = np.einsum("ij,ij->i", away, away)
        computed += len(rows)
        best = exact.argmin(axis=1)
        cluster.append(best)
        distance.append(exact[np.arange(len(block)), best])
    if not cluster:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return np.concatenate(cluster), np.concatenate(distance), computed


def integer_vectors(table: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<int>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall(v, lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(LARGEST)))
    error = F.raise_error(F.lit(f"a component of an embedding is {LARGEST} or more, scaled: distances are longs"))
    return table.filter((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, scaled.cast("array<int>")).otherwise(error).alias("v")
    )


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and vec_id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in top], np.int64)


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), width)


def _with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    dim = simplex.pivots.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column(1), dim, np.int64))
            listed = pa.ListArray.from_arrays(
                np.arange(0, apexes.size + 1, apexes.shape[1], dtype=np.int32), pa.array(apexes.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["vec_id", "v", "apex"])

    return rows.mapInArrow(run, "vec_id long, v array<int>, apex array<double>")


def _sums(staged: DataFrame, simplex: Simplex, centroids: np.ndarray) -> dict[int, list[int]]:
    """Per centroid that has vectors: how many, and the sum of each component (exact)."""
    centres = simplex.apexes(centroids)
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), dim, np.int64)
            cluster, _, _ = nearest(vectors, _matrix(batch.column(1), centres.shape[1], np.float64), centroids, centres)
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                sums[c, 0] += len(own)
                sums[c, 1:] += own.sum(axis=0)
        used = np.nonzero(sums[:, 0])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dim + 1)), pa.array(np.tile(np.arange(dim + 1), len(used))), pa.array(sums[used].ravel())],
            names=["cluster", "at", "part"],
        )

    parts = staged.select("v", "apex").mapInArrow(run, "cluster long, at long, part long")
    out: dict[int, list[int]] = {}
    # A sum over all vectors may pass a long where a task's cannot: add as decimals.
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r["cluster"], [0] * (dim + 1))[r["at"]] = int(r["total"])
    return out


def _assigned(staged: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    centres = simplex.apexes(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(
                _matrix(batch.column(1), centroids.shape[1], np.int64),
                _matrix(batch.column(2), centres.shape[1], np.float64), centroids, centres,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return staged.mapInArrow(run, "vec_id long, cluster int, distance long")


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame([], "vec_id long, cluster int, distance long"),
        spark.createDataFrame([], "cluster int, centroid array<int>"),
    )


def cluster_vectors(
    table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
    seed: int = SEED, pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance of every vector kept; cluster and centroid, ``k`` rows at most)."""
    spark = table.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = integer_vectors(table, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return _empty(spark)
    simplex = Simplex(centroids, pivots)
    staged = scratch.stage(_with_apexes(rows, simplex), "vectors")
    for _ in range(rounds):
        for c, (n, *total) in _sums(staged, simplex, centroids).items():
            centroids[c] = [t // n for t in total]
    assigned = scratch.stage(_assigned(staged, simplex, centroids), "assigned")
    scratch.drop("vectors")
    centres = [(i, c) for i, c in enumerate(centroids.tolist())]
    return assigned, spark.createDataFrame(centres, "cluster int, centroid array<int>")


def clustered(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia and inertia (sums of distance), centroid of every vector kept."""
    assigned, centroids = cluster_vectors(table, **options)
    spark = table.sparkSession
    # One row a cluster, k at most: collected for the total, and small enough to broadcast.
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    known = [(r["cluster"], inertia[r["cluster"]], sum(inertia.values()), r["centroid"])
             for r in centroids.collect() if r["cluster"] in inertia]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
