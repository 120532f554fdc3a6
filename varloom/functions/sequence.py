"""Protein-sequence expressions: point substitution and FASTA record parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position_index(position: Column) -> Column:
    """String position → int; text that is not an integer gives null (no ANSI error)."""
    return position.try_cast("int")


def substitute(sequence: Column, pos: Column, alt: Column) -> Column:
    """``sequence`` with the residue at 1-based ``pos`` replaced by ``alt``.

    A position beyond the end appends ``alt``; a position below 1 gives null.
    """
    return F.when(
        pos >= 1,
        F.concat(
            F.substring(sequence, F.lit(1), pos - 1),
            alt,
            F.substring(sequence, pos + 1, F.length(sequence)),
        ),
    )


def residue_at(sequence: Column, pos: Column) -> Column:
    return F.when(pos >= 1, F.substring(sequence, pos, F.lit(1)))


def fasta_id(record: Column) -> Column:
    """First whitespace-free token of the header line (leading ``>`` optional)."""
    return F.regexp_extract(record, r"^>?(\S+)", 1)


def fasta_description(record: Column) -> Column:
    return F.regexp_extract(record, r"^>?\S*[ \t]*([^\r\n]*)", 1)


def fasta_body(record: Column) -> Column:
    """Everything after the header line, with all whitespace (LF, CR, blanks) removed."""
    return F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s+", "")
