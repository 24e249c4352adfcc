"""Rows by (doc_id, row), read for the documents that are asked for only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a few longs that may be broadcast (3 MB or so); more are shuffled.
BROADCAST_ROWS = 100_000


def only_rows(big: DataFrame, small: DataFrame, on: list[str], entries: int) -> DataFrame:
    """``big`` joined to ``small`` (null-safe): by broadcast if ``entries``, the counted
    number of its rows or of its arrays' elements, is bounded; else by a shuffle."""
    small = F.broadcast(small) if entries <= BROADCAST_ROWS else small
    renamed = small.select([F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in small.columns])
    cond = None
    for c in on:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = test if cond is None else cond & test
    return big.join(renamed, cond).drop(*[f"_{c}" for c in on])


#: Bits of a set of rows, in words of 64: at most 262,144 rows of two longs to broadcast.
BITS = 1 << 24


def likely_rows(big: DataFrame, small: DataFrame) -> DataFrame:
    """The rows of ``big`` whose ``row``, a hash, has its bit set by one of ``small``: all that
    ``small`` has and few others, so that a shuffle needn't move the rest. Null in neither."""
    word, bit = F.expr(f"shiftright(row & {BITS - 1}L, 6)"), "cast(row & 63L as int)"
    bits = small.select(word.alias("_word"), F.expr(f"shiftleft(1L, {bit})").alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return big.join(F.broadcast(bits), word == F.col("_word")).where(F.expr(f"shiftright(_bits, {bit}) & 1L = 1L")).drop("_word", "_bits")
