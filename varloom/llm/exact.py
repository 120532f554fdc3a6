"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest doc_id stays. Equality is decided by the
SHA-256 of the normalised text, which stands in a narrow staged table of one row a
document, so the texts are read once here and never shuffled.

A text that very many rows share would gather in one task of a shuffle on the digest.
Misra-Gries counters find such digests: Spark's frequent-items sketch keeps
``COUNTERS`` of them per task (a full table is lowered and its zeros dropped), and the
sketches merge in ``LANES`` groups, then once. A digest of at least ``n / share`` rows
cannot be missing; what the counters hold besides costs nothing but a place in a
bounded list. The candidates are verified by an exact, map-side combined count that
also finds the row that stays. The digests that pass (at most ``share``, so the
broadcast is bounded) are settled map-side; all others, each under ``n / share`` rows,
take an ordinary shuffle.

A null doc_id sorts before all others. Rows that tie (equal texts and one doc_id) are
one group like others, and exactly one of its rows with the largest doc_id stays.
Empty texts are equal to each other; long texts are read whole; extra columns, whatever
their names, pass through ``remove_duplicates`` and are ignored by ``duplicate_groups``;
an empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import Scratch, id_order, text_of, unused

#: A digest of one in SHARE rows or more is heavy.
SHARE = 1_000
#: Counters of a sketch; its table has 8,192 places, so a count is short by 3.5 / 8,192 of the rows at most.
COUNTERS = 4_096
LANES = 64


def normalised_digest(column: str = "text") -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased."""
    text = text_of(column)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.sha2(
        F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)), 256
    )


def frequent_digests(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """digest: at most ``share`` and a quarter of them, with every one of at least ``1 / share`` of the rows."""
    counters = max(COUNTERS, 4 * share)
    lanes = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("sketch")
    )
    # Grouped by a constant, not globally: without rows there is no sketch to read.
    merged = lanes.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
    top = F.expr(f"approx_top_k_estimate(sketch, {share + share // 4})")
    return merged.select(F.explode(top).alias("top")).select(F.col("top.item").alias("digest"))


def heavy_winners(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """digest, n, last (the row that stays) of the digests that hold ``1 / share`` of the rows, counted exactly."""
    least = rows.count() / share
    counted = (
        rows.join(F.broadcast(frequent_digests(rows, share)), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("last"))
    )
    return counted.filter((F.col("n") > 1) & (F.col("n") >= least))


def _settled(scratch: Scratch, docs: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """(marks, winners): id, digest, row, n and last of every row, heavy digests settled by the broadcast winners."""
    rows = scratch.stage(
        docs.select(
            id_order("doc_id").alias("id"), normalised_digest().alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    winners = scratch.stage(heavy_winners(rows, share), "winners")
    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", "row", F.count("*").over(group).alias("n"), F.max(F.struct("id", "row")).over(group).alias("last")
    )
    return heavy.unionByName(light), winners


def duplicate_groups(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of every row."""
    marks, _ = _settled(Scratch(docs.sparkSession, "exact"), docs, share)
    no_id = F.lit(-(2**63)).cast("long")
    return marks.select(
        F.nullif("id", no_id).alias("doc_id"), F.nullif("last.id", no_id).alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def remove_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest doc_id; same columns.

    Rows of heavy texts leave before any shuffle; of the others only the places of those
    that go are shuffled against the documents. Of rows that tie in text (as normalised)
    and doc_id any one stays.
    """
    scratch = Scratch(docs.sparkSession, "exact_kept")
    digest, id_, last = unused(docs, "digest"), unused(docs, "id"), unused(docs, "last")
    marks, winners = _settled(scratch, docs, share)
    light = scratch.stage(
        marks.join(F.broadcast(winners.select("digest")), "digest", "left_anti").filter("n > 1"), "light"
    )
    goes = light.filter(F.col("id") < F.col("last.id")).select(F.col("id").alias(id_), F.col("digest").alias(digest)).distinct()
    tied = (
        marks.filter((F.col("id") == F.col("last.id")) & (F.col("row") != F.col("last.row")))
        .select(F.col("id").alias(id_), F.col("digest").alias(digest)).distinct()
    )
    tied = scratch.stage(tied, "tied")
    best = winners.select(F.col("digest").alias(digest), F.col("last.id").alias(last))

    keyed = docs.withColumn(digest, normalised_digest()).withColumn(id_, id_order("doc_id"))
    left = keyed.join(F.broadcast(best), digest, "left").filter(F.col(last).isNull() | (F.col(id_) == F.col(last)))
    left = left.join(goes, [id_, digest], "left_anti")
    if not tied.isEmpty():
        several = left.join(tied, [id_, digest], "left_semi").dropDuplicates([id_, digest])
        left = left.join(tied, [id_, digest], "left_anti").unionByName(several)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
