"""Helpers shared by the training-data operators.

Scratch tables go to the folder the cluster names in ``spark.checkpoint.dir``
(through :func:`varloom.session.shared_path`), so a lost executor re-reads them
instead of recomputing, and every later branch of a plan starts from a file.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.session import shared_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Key sets up to this many bytes (16 per key) are broadcast; larger ones are shuffled.
BROADCAST_KEY_BYTES = 32 << 20
#: Rows (of a few numbers each) that one task may handle alone.
NARROW_ROWS = 100_000
#: Bytes of text that a Python worker takes on at a time, whatever the rows of a batch.
SLICE_BYTES = 4 << 20
#: Share of the driver's largest heap that steps may fill between them without a collection.
HEAP_SHARE = 0.4


def importable(spark: SparkSession) -> None:
    """Put this library on the Python workers' path, wherever the driver found it."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in path:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, path)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> bool:
    """Collect the driver's garbage where its heap has grown past ``HEAP_SHARE`` of its limit; whether it did.

    A job of many steps leaves plans, metrics, task results and the handles of shuffles and broadcasts behind. The
    driver's heap grows to its limit before it collects all of them, and stays that large; Spark deletes the shuffle
    files and broadcasts only then.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= HEAP_SHARE * heap.maxMemory():
        return False
    gc.collect()  # a DataFrame that Python still holds keeps its plan in the JVM
    spark._jvm.java.lang.System.gc()
    return True


class Scratch:
    """Scratch tables of one run; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark, self.root = spark, shared_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as parquet once and return the written table."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A written table of ``rows`` rows; with ``NARROW_ROWS`` at most, as one partition.

    Joins, windows and groups over one partition need no shuffle, so a small table costs
    one task and not one per shuffle partition. Larger tables stay as they are.
    """
    return df.coalesce(1) if rows <= NARROW_ROWS else df


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """The same for a join's small side: broadcast up to ``NARROW_ROWS`` rows."""
    return F.broadcast(df) if rows <= NARROW_ROWS else df


def keep_keys(df: DataFrame, keys: DataFrame, on: str, limit_bytes: int = BROADCAST_KEY_BYTES) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (a written table of distinct longs).

    The keys are counted first: a set under ``limit_bytes`` is broadcast, so the
    rows left out never reach a shuffle; a larger one takes a shuffled semi join.
    """
    if keys.count() * 16 <= limit_bytes:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_order(column: str = "doc_id") -> Column:
    """A non-null sort key of an id: a null id comes before every other."""
    return F.coalesce(F.col(column), F.lit(-(2**63)).cast("long"))


def unused(df: DataFrame, name: str) -> str:
    """A column name for working use that ``df`` does not have (case does not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def require_free(df: DataFrame, *names: str) -> None:
    """Raises where ``df`` has one of the columns that an operator would add or work with."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"documents have a column {name!r} already: rename it first")


def text_slices(batches: Iterable[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into consecutive rows of ``limit`` bytes of text (column ``at``) at most, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
