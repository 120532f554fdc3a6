"""Pathogenic context of a row: positions of the *other* pathogenic rows of the
same protein and phenotype.

Computed as a group aggregate, never row against row:

1. count the pathogenic rows per (group, position), capped at 2 (combined
   map-side), then collect those positions per group, sorted — at most ``2n``
   entries per group for any input;
2. join that list back to the rows (the group side is already partitioned on
   the join key, so only the rows are shuffled);
3. drop one occurrence of the row's own position (when the row itself is
   counted) and de-duplicate — native array functions, no per-element lambda.

Bounded state: positions are ints in ``[1, n]``, so a group's list holds at most
``2n`` entries however many rows the group has. Rows are unique per (protein,
position, phenotype), so in practice a group also has at most about ``n`` rows
and is no hot key for the join back. The result is sparse — a sorted
``array<int>`` — and dense vectors are made only by the sink.

Scopes:

* ``within_split`` — each part sees only its own rows' labels;
* ``from_train`` — every row sees the labels of the training part only (a
  training row still excludes itself), so validation/test labels never leak.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.sequence import position_index

GROUP_COLUMNS = ("NP_transcript", "phenotype_list")
SCOPES = ("within_split", "from_train")


def context_positions(
    rows: DataFrame,
    scope: str = "within_split",
    split_col: str = "split",
    source_split: str = "train",
    group_cols: Sequence[str] = GROUP_COLUMNS,
    col: str = "context_positions",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``col``: the sorted context positions of each row.

    With ``partitions``, the rows are first hash-partitioned on the group key
    into that many partitions; the collect and the join back then reuse that
    partitioning (no further shuffle of the rows), and so can a following sink.
    Groups are bounded by ``n`` rows, so this partitioning has no hot key.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    pos = position_index(F.col("position"))
    pathogenic = F.col("is_pathogenic") == 1

    if scope == "within_split":
        part_cols = [split_col, *group_cols]
        in_source = F.lit(True)
    else:
        part_cols = list(group_cols)
        in_source = F.col(split_col) == source_split
    self_counted = pathogenic & in_source
    if partitions:
        rows = rows.repartition(partitions, *part_cols)

    # Pathogenic rows per (group, position), capped at 2: enough to remove one
    # row's own occurrence exactly, and it bounds a group's list to 2n entries
    # whatever the input (even many spellings of one position, such as "7" and
    # "007"). The count combines map-side.
    per_position = (
        rows.filter(pathogenic & in_source)
        .groupBy(*part_cols, pos.alias("__p"))
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("__m"))
    )
    per_group = (
        per_position.select(*part_cols, F.explode(F.array_repeat(F.col("__p"), F.col("__m").cast("int"))).alias("__p"))
        .groupBy(*part_cols)
        .agg(F.array_sort(F.collect_list("__p")).alias("__positions"))
    )
    joined = rows.join(per_group, on=part_cols, how="left")

    positions = F.coalesce(F.col("__positions"), F.array().cast("array<int>"))
    # 1-based index of the row's own position in the sorted list; 0 when not counted.
    own = F.when(self_counted, F.array_position(positions, pos)).otherwise(F.lit(0)).cast("int")
    without_own = F.when(
        own > 0,
        F.concat(
            F.slice(positions, F.lit(1), own - 1),
            F.slice(positions, own + 1, F.greatest(F.size(positions) - own, F.lit(0))),
        ),
    ).otherwise(positions)
    return joined.withColumn(col, F.array_distinct(without_own)).select(*rows.columns, col)
