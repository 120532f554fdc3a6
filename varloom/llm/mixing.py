"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and
share the words of all documents; a target stops at ``MAX_REPEATS`` times its
source's size and the excess is shared again by weight until none is above.

Budget: a source takes whole passes over its documents while they fit. What is left
is a subset-sum over the exact lengths: the documents are counted by length, each
length first gives its proportional share, the counts left over give greedily from
the longest down while the budget is far off, and a bounded-knapsack dynamic
programme over all lengths left closes the last ``DP_BUDGET`` words as nearly as
they can be. Of each length, the documents that take one more pass are the first
by seeded hash of doc_id.

Everything that leaves the tasks is a histogram (source, length, count): its size
follows the number of distinct lengths, not of documents. A length of a source
that holds a third of all rows is cut by hash prefix; only the prefix on the border
is ranked. Null text has size 0, takes nothing and is returned; repeated rows count
as documents of their own and rank among themselves in any order, which gives the
same rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, text_of

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words left to the dynamic programme; its table has this many cells at most.
DP_BUDGET = 200_000
#: Evenly spaced lengths offered to the dynamic programme first; all others follow while the budget is not met.
DP_LENGTHS = 400
SEED = 20
HASH_PREFIXES = 1 << 14


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, cap: float = MAX_REPEATS):
    """{source: target} for (source, words) pairs: weighted shares, capped and shared again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))  # str order is code-point order
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_ = float(sum(size.values())), list(size)
    out = dict.fromkeys(size, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * size[s]]
        if not over:
            for s in open_:
                out[s] = left * weight[s] / total
            break
        for s in over:
            out[s] = float(cap * size[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def closest_subset(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is the largest possible within ``budget``.

    Bounded-knapsack dynamic programme on a bit set: counts are split in powers of
    two, each new sum remembers the item that first reached it.
    """
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    by = np.full(budget + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        part = 1
        count = min(count, budget // length) if length > 0 else 0
        while count > 0:
            n = min(part, count)
            weight = n * length
            new = reach[: budget + 1 - weight] & ~reach[weight:]
            where = np.nonzero(new)[0] + weight
            reach[where] = True
            by[where] = len(items)
            items.append((k, n))
            count -= n
            part *= 2
        if reach[budget]:
            break
    take = [0] * len(lengths)
    at = int(np.nonzero(reach)[0][-1])
    while at > 0:
        k, n = items[by[at]]
        take[k] += n
        at -= n * lengths[k]
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each (positive, ascending) length so that the words come nearest to ``budget``."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = counts * budget // max(total, 1)
    left = budget - int((take * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):  # far from the budget: whole documents, longest first
        if left <= DP_BUDGET:
            break
        n = min(int(counts[i] - take[i]), (left - DP_BUDGET // 2) // int(lengths[i]))
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    free = np.nonzero(take < counts)[0]
    if len(free) > DP_LENGTHS:
        early = np.zeros(len(free), bool)
        early[np.linspace(0, len(free) - 1, DP_LENGTHS).astype(int)] = True
        free = np.concatenate((free[early], free[~early]))
    more = closest_subset([int(x) for x in lengths[free]], [int(x) for x in (counts - take)[free]], max(0, left))
    take[free] += np.array(more, dtype=take.dtype)
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram: passes for every document, and how many of each length take one more."""
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total = int((lengths * counts).sum())
    target = float(pdf["target"].iloc[0])
    passes = min(MAX_REPEATS, int(target // total)) if total else 0
    budget = 0 if passes == MAX_REPEATS else int(round(target - passes * total)) if total else 0
    take = np.zeros(len(lengths), dtype=np.int64)
    some = lengths > 0
    take[some] = fit_counts(lengths[some], counts[some], budget)
    return pdf.assign(passes=passes, take=take)[["source_key", "size", "passes", "take"]]


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (a multiple of size) of every document.

    The sources and their sizes meet on the driver (one row a source), the histogram
    of a source in one task (one row a distinct length).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # A null source is its own source: the key keeps it apart from every string.
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sized = scratch.stage(
        docs.select("doc_id", "source", key.alias("source_key"), word_count(text_of()).alias("size")), "sizes"
    )
    hist = scratch.stage(sized.groupBy("source_key", "size").agg(F.count("*").alias("n")), "hist")
    per_source = hist.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    wanted = targets([(None if r[0] == "n" else r[0][1:], r[1]) for r in per_source])
    rows = [(r[0], r[1], float(wanted[None if r[0] == "n" else r[0][1:]])) for r in per_source]
    goal = spark.createDataFrame(rows, "source_key string, source_size long, target double")
    plan = (
        hist.join(goal, "source_key")
        .groupBy("source_key")
        .applyInPandas(_plan, "source_key string, size long, passes long, take long")
    )
    plan = scratch.stage(plan.join(goal, "source_key"), "plan")

    group = ["source_key", "size"]
    ranked = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = sized.withColumn("rank_hash", ranked).withColumn(
        "prefix", F.shiftrightunsigned("rank_hash", 50).cast("int")
    )
    open_ = plan.filter("take > 0").select(*group, "take")
    per_prefix = marked.join(open_, group, "left_semi").groupBy(*group, "prefix").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(*group).orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    borders = (
        per_prefix.withColumn("upto", F.sum("m").over(upto))
        .join(open_, group)
        .filter("upto >= take")
        .groupBy(*group)
        .agg(F.min(F.struct("prefix", (F.col("take") - (F.col("upto") - F.col("m"))).alias("rest"))).alias("b"))
        .select(*group, F.col("b.prefix").alias("border"), F.col("b.rest").alias("rest"))
    )
    quota = scratch.stage(plan.join(borders, group, "left"), "quota")
    placed = marked.join(quota, group)
    # Only documents on the border prefix are ranked; the others are in or out by their prefix alone.
    clear = placed.filter(F.col("border").isNull() | (F.col("prefix") != F.col("border"))).withColumn(
        "extra", F.coalesce(F.col("prefix") < F.col("border"), F.lit(False)).cast("long")
    )
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("rank_hash", "doc_id"))
    edge = placed.filter(F.col("prefix") == F.col("border")).withColumn("extra", (nth <= F.col("rest")).cast("long"))
    return clear.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target",
        ((F.col("passes") + F.col("extra")) * F.col("size")).alias("taken"),
    )
