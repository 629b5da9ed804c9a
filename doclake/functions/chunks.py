"""Chunk expressions: token estimate, size heuristic, character and line spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column, let


def token_estimate(c) -> Column:
    """One token for four characters, rounded down."""
    return F.floor(F.length(column(c)) / 4).cast("int")


def optimal_chunk_size(length, target_chunks: int | None = None) -> Column:
    """Chunk size from the text length, or from the wanted number of chunks."""
    n = column(length)
    if target_chunks:
        size = F.floor(n / target_chunks)
        return (
            F.when(size < 500, 500).when(size > 2000, 2000).otherwise((F.floor(size / 100) * 100)).cast("int")
        )
    return F.when(n < 2000, 500).when(n < 10000, 1000).when(n < 50000, 1500).otherwise(2000).cast("int")


def first_span(content, piece) -> Column:
    """Span of the first occurrence of ``piece`` (0-based, end exclusive); NULLs where it does not occur."""
    piece = column(piece)
    return let(
        F.position(piece, column(content)),
        lambda p: F.struct(
            F.when(p > 0, p - 1).cast("int").alias("char_start"),
            F.when(p > 0, p - 1 + F.length(piece)).cast("int").alias("char_end"),
        ),
    )


def line_number(content, offset) -> Column:
    """1-based line of a character offset; only ``\\n`` ends a line."""
    head = F.left(column(content), column(offset))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_span(content, char_start, char_end) -> Column:
    start, end = column(char_start), column(char_end)
    return F.struct(
        line_number(content, start).alias("start_line"),
        line_number(content, F.greatest(end - 1, start)).alias("end_line"),
    )
