"""Mutation and context vectors.

Inside the engine a mutation is its int position and a context is a sorted
array of distinct positions (sparse). Dense arrays of width ``n`` are built only
at the sink, in O(n + k) per row with array built-ins, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.constants import MAX_SEQUENCE_LENGTH


def mutation_dense(pos: Column, n: int = MAX_SEQUENCE_LENGTH) -> Column:
    """One-hot ``array<float>`` of width ``n`` with 1.0 at index ``pos`` (1-based).

    Callers keep ``1 <= pos <= n`` (the position filter does).
    """
    zero = F.lit(0.0).cast("float")
    return F.concat(
        F.array_repeat(zero, pos - 1),
        F.array(F.lit(1.0).cast("float")),
        F.array_repeat(zero, F.lit(n) - pos),
    )


def context_dense(positions: Column, n: int = MAX_SEQUENCE_LENGTH) -> Column:
    """Multi-hot ``array<int>`` of width ``n`` from sorted, distinct positions in ``[1, n]``.

    Built as runs: for each position, the zeros since the previous one, then a 1;
    then the trailing zeros. Linear in ``n`` plus the number of positions.
    """
    runs = F.transform(
        positions,
        lambda p, i: F.concat(
            F.array_repeat(F.lit(0), p - F.coalesce(F.get(positions, i - 1), F.lit(0)) - 1),
            F.array(F.lit(1)),
        ),
    )
    last = F.coalesce(F.get(positions, F.size(positions) - 1), F.lit(0))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0), F.lit(n) - last))


def hot_positions(dense: Column) -> Column:
    """1-based indices of the non-zero entries of a dense vector (one pass)."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(dense), F.lit(1))),
        lambda i: F.coalesce(F.try_element_at(dense, i) != 0, F.lit(False)),
    )


def join_ints(values: Column, sep: str = ",") -> Column:
    """Array of ints → ``'1,5,9'`` (used for order-stable comparison)."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def feature_tokens(pos: Column, context: Column) -> Column:
    """``['m<pos>', 'c<p1>', 'c<p2>', ...]``: the two vectors as tokens of a fixed vocabulary."""
    return F.concat(
        F.array(F.concat(F.lit("m"), pos.cast("string"))),
        F.transform(context, lambda p: F.concat(F.lit("c"), p.cast("string"))),
    )


def token_vocabulary(n: int = MAX_SEQUENCE_LENGTH) -> list[str]:
    """Mutation slots ``m1..mn`` then context slots ``c1..cn``: positional layout of width 2n."""
    return [f"m{i}" for i in range(1, n + 1)] + [f"c{i}" for i in range(1, n + 1)]


def two_channels(mutation: Column, context: Column) -> Column:
    """Channel 0 = mutation, channel 1 = context (kept apart, not concatenated)."""
    return F.array(mutation.cast("array<float>"), context.cast("array<float>"))
