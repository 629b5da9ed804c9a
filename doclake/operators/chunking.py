"""Documents to chunks, chunk numbering and per-document statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.chunks import token_estimate
from doclake.functions.patterns import blocks, column, cut, let
from doclake.functions.splitting import SPAN_TYPE, split_batch

CHUNK_SIZE = 4000
CHUNK_OVERLAP = 800


def chunk_spans(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunk spans. Only the text goes to Python and only offsets come back."""
    if size < 2 or not 0 <= overlap < size:
        raise ValueError("chunk size must be at least 2 and larger than the overlap")

    @F.arrow_udf(SPAN_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        return split_batch(texts, size, overlap)

    return spans(column(text))


def chunks_of(text, spans, overlap: int = CHUNK_OVERLAP, kind: str = "text") -> Column:
    """Array of chunk structs cut from the text at the given spans, in the JVM."""

    def record(pieces: Column, s: Column, i: Column) -> Column:
        content = cut(pieces, s["char_start"], s["char_end"])
        size = s["char_end"] - s["char_start"]
        return F.struct(
            i.cast("int").alias("chunk_index"),
            content.alias("content"),
            F.floor(size / 4).cast("int").alias("tokens"),
            s["start_line"].alias("start_line"),
            s["end_line"].alias("end_line"),
            s["char_start"].alias("char_start"),
            s["char_end"].alias("char_end"),
            F.struct(
                i.cast("int").alias("chunk_index"),
                F.lit(kind).alias("chunk_type"),
                size.cast("int").alias("chunk_size"),
                F.when(i > 0, overlap).otherwise(0).cast("int").alias("chunk_overlap"),
                s["error"].alias("error"),
            ).alias("metadata"),
        )

    return let(blocks(text), lambda pieces: F.transform(column(spans), lambda s, i: record(pieces, s, i)))


def chunk_documents(
    df: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "content",
    keys: tuple[str, ...] = ("doc_id",),
    kind: str = "text",
) -> DataFrame:
    """One row per chunk. A narrow transformation: no shuffle, however long or repeated the documents are."""
    spanned = df.select(*keys, text, chunk_spans(text, size, overlap).alias("_spans"))
    rows = spanned.select(*keys, F.explode(chunks_of(text, "_spans", overlap, kind)).alias("_chunk"))
    return rows.select(*keys, "_chunk.*")


def renumber(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Drop chunks without a vector and number the rest 0..n-1 within each document."""
    order = Window.partitionBy(*keys).orderBy("chunk_index")
    return df.where(F.col("embedding").isNotNull()).withColumn("chunk_index", F.row_number().over(order) - 1)


def doc_stats(docs: DataFrame, chunks: DataFrame, snippets: DataFrame, text: str = "content") -> DataFrame:
    """Length, chunk and snippet totals per document."""
    n_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    n_snippets = snippets.groupBy("doc_id").agg(F.count("*").alias("total_code_snippets"))
    return (
        docs.select("doc_id", F.length(text).alias("original_length"))
        .join(n_chunks, "doc_id", "left")
        .join(n_snippets, "doc_id", "left")
        .fillna(0, ["total_chunks", "total_code_snippets"])
    )


__all__ = ["chunk_documents", "chunk_spans", "chunks_of", "doc_stats", "renumber", "token_estimate"]
