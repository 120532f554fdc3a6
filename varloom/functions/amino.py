"""Three-letter → one-letter amino-acid codes as a literal map lookup.

Unknown codes (``Ter``, ``''``) pass through unchanged; null stays null.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.constants import AMINO_ACIDS


def _code_map(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])


def one_letter(code: Column, codes: dict[str, str] = AMINO_ACIDS) -> Column:
    """``coalesce(map[code], code)``; the map is a folded literal."""
    return F.coalesce(_code_map(codes)[code], code)
