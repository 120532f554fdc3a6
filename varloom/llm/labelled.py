"""The labelled documents that a classifier here may be fitted on, all or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def labelled_ids(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and label (0 or 1) of all rows but those whose crc remainder is ``held_out``.

    Null labels take no part; a doc_id with both labels counts as the larger one.
    """
    return (
        labels.filter(crc_remainder(F.col("doc_id"), modulus) != held_out)
        .filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )


def sample(
    docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int,
    per_class: dict[int, int], max_chars: int,
) -> dict[int, list[str]]:
    """{label: texts}: up to ``per_class[label]`` distinct texts of at most ``max_chars`` characters each.

    Rows whose crc remainder is ``held_out`` and null labels take no part; a doc_id
    with both labels counts as the larger one. The sample is the first by a hash of
    doc_id, so it is the same on every run, and it is bounded by its parameters:
    its ids are broadcast, its texts collected.
    """
    ids = labelled_ids(labels, column, modulus, held_out)
    found: dict[int, list[str]] = {}
    for label, n in per_class.items():
        first = ids.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        rows = (
            docs.select("doc_id", "text")
            .filter(F.col("text").isNotNull() & (F.length("text") <= max_chars) & (F.length("text") > 0))
            .join(F.broadcast(first.select("doc_id")), "doc_id")
            .groupBy("text")
            .agg(F.min(F.xxhash64("doc_id")).alias("at"))
            .orderBy("at", "text")
            .select("text")
        )
        found[label] = [r["text"] for r in rows.limit(n).collect()]
    return found
