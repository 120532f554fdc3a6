"""Row counts taken in passing: ``Observation`` metrics on a job's own pass.

``PassCounts.mark`` puts a counter at a place of the plan; the counters fill while the job
writes its table, without a second scan. ``PassCounts.table`` gives one row a counter
once the write is done. A counter sees the rows that pass its place; where a stage is run
again after a lost executor, Spark merges the accumulators of successful tasks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step string, n long"


class PassCounts:
    """Named counters of one job."""

    def __init__(self) -> None:
        self._seen: list[tuple[list[str], Observation]] = []

    def mark(self, df: DataFrame, rows: str | None = None, **matching: Column) -> DataFrame:
        """``df`` with counters: ``rows`` counts them all, each of ``matching`` those where its condition holds."""
        exprs = {rows: F.count(F.lit(1))} if rows else {}
        exprs |= {name: F.count_if(condition) for name, condition in matching.items()}
        taken = {n for names, _ in self._seen for n in names}
        if taken & set(exprs):
            raise ValueError(f"counted twice: {sorted(taken & set(exprs))}")
        seen = Observation()
        self._seen.append((list(exprs), seen))
        return df.observe(seen, *[e.alias(n) for n, e in exprs.items()])

    def values(self) -> dict[str, int]:
        """All counters, in the order they were placed; waits for the job that fills them."""
        return {name: int(seen.get[name]) for names, seen in self._seen for name in names}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.values().items()), SCHEMA)
