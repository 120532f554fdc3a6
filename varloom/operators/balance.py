"""Group split by size: whole groups in one part, parts close to their ratios.

A hash split of a group key keeps groups whole but leaves the parts to chance; with few
large proteins they can miss their ratios by far. Here groups go to parts by size,
largest first, each to the part furthest under its target. Groups of one size are
interchangeable, so the plan needs only the histogram of sizes: at most ``sqrt(2 * rows)``
different ones, whatever the number of groups. Spark counts the groups and numbers them
by (size, seeded hash) without a global sort; a group's number within its size tells its
part. Each part ends within the largest group's size of its target.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.constants import SPLIT_NAMES, SPLIT_RATIOS, SPLIT_SEED
from varloom.functions.hashing import hash_key
from varloom.operators.batches import number_rows
from varloom.operators.split import SPLIT_KEYS, check_ratios
from varloom.session import stage


def _deal(short: list[Fraction], size: int, m: int) -> list[int]:
    """How many of ``m`` groups of one size each part takes, one by one to the part furthest short (ties: first part).

    ``short`` is what the parts lack before, and is lowered. All picks down to a common
    level are made at once; only the last few, less than one a part, are made singly.
    """
    order = sorted(range(len(short)), key=lambda p: -short[p])
    level = Fraction(0)
    for k in range(1, len(order) + 1):  # the k shortest parts take all of them, down to one level
        level = (sum(short[p] for p in order[:k]) - m * size) / k
        if k == len(order) or short[order[k]] <= level:
            break
    taken = [max(0, (s - level) // size) for s in short]
    for p, t in enumerate(taken):
        short[p] -= t * size
    for _ in range(m - sum(taken)):
        p = max(range(len(short)), key=lambda q: (short[q], -q))
        taken[p] += 1
        short[p] -= size
    return [int(t) for t in taken]


def plan_parts(histogram: Sequence[tuple[int, int]], ratios: Sequence[float]) -> list[tuple[int, list[int]]]:
    """(size, groups that each part takes) for a histogram of (size, groups), largest size first."""
    total = sum(size * m for size, m in histogram)
    short = [Fraction(str(r)) * total for r in ratios]
    return [(size, _deal(short, size, m)) for size, m in sorted(histogram, reverse=True)]


def assign_balanced(
    df: DataFrame,
    key: Sequence[str] | str = "protein",
    ratios: Sequence[float] = SPLIT_RATIOS,
    names: Sequence[str] = SPLIT_NAMES,
    seed: int = SPLIT_SEED,
    col: str = "split",
) -> DataFrame:
    """Add ``col`` naming the part of each row; rows with one ``key`` (nulls included) are in one part."""
    check_ratios(ratios)
    if len(ratios) != len(names):
        raise ValueError("one name per ratio")
    key_cols = list(SPLIT_KEYS[key] if isinstance(key, str) else key)
    groups = stage(df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__n")), "groups")
    counted = groups.groupBy("__n").agg(F.count(F.lit(1)).alias("m")).collect()
    bounds, first = [], 0
    for size, taken in plan_parts([(r["__n"], r["m"]) for r in counted], ratios):
        ends = [first + sum(taken[: p + 1]) for p in range(len(taken))]
        bounds.append((size, ends))
        first = ends[-1]
    spark = df.sparkSession
    ends = F.broadcast(spark.createDataFrame(bounds, "__n long, __ends array<long>"))
    numbered = number_rows(groups, [F.desc("__n"), F.md5(hash_key(key_cols, seed, "balanced")), *key_cols], "__row")
    # The first part whose last number is beyond the group's.
    part = F.size(F.filter("__ends", lambda e: e <= F.col("__row")))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), part + 1)
    parts = numbered.join(ends, "__n").select(*[F.col(c).alias(f"__{c}") for c in key_cols], label.alias(col))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key_cols]
    return df.join(parts, same).select(*[F.col(f"`{c}`") for c in df.columns], col)
