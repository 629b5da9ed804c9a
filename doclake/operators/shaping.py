"""Shapes of search results: standard, promoted metadata, compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.code import filled_line_count, line_count

SUMMARY_CUT = 150
CODE_CUT = 500
# Fields dropped from results, and metadata keys that mean nothing for snippets.
DROPPED = ["snippet_type", "content_type", "type"]
DROPPED_CODE = [*DROPPED, "title"]
DEPRECATED_KEYS = ["language", "start_line", "end_line", "char_start", "char_end", "type", "chunk_index"]


def _cut(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def standardize(df: DataFrame) -> DataFrame:
    """Drop ambiguous fields; ``metadata`` becomes {document, chunk, code_snippets}."""
    part = lambda c: (F.col(c) if c in df.columns else F.lit(None)).alias(c)
    meta = F.struct(
        F.struct(part("doc_id"), part("title"), part("url"), part("parent_page_size"), part("parent_total_chunks")).alias(
            "document"
        ),
        F.struct(part("chunk_index"), part("start_line"), part("end_line"), part("char_start"), part("char_end")).alias(
            "chunk"
        ),
        part("code_snippets"),
    )
    return df.withColumn("metadata", meta).drop(*DROPPED)


def standardize_code(df: DataFrame) -> DataFrame:
    """Drop ambiguous fields and deprecated metadata keys; make sure there is a line count."""
    out = df
    if "metadata" in df.columns:
        out = out.withColumn("metadata", F.map_filter("metadata", lambda k, _: ~k.isin(DEPRECATED_KEYS)))
    counted = line_count("content")
    if "line_count" in df.columns:
        counted = F.coalesce("line_count", counted)
    return out.withColumn("line_count", counted).drop(*DROPPED_CODE)


def promote_metadata(df: DataFrame, metadata: str = "doc_metadata") -> DataFrame:
    """Page URL, source type, base URL, page flag and source title from a metadata map to the top level."""
    key = lambda k: F.try_element_at(F.col(metadata), F.lit(k))
    return (
        df.withColumn("page_url", F.coalesce(key("page_url"), F.col("url")))
        .withColumn("source_type", key("source_type"))
        .withColumn("base_url", key("base_url"))
        .withColumn("is_individual_page", F.coalesce(key("is_individual_page").try_cast("boolean"), F.lit(False)))
        .withColumn("source_title", key("source_title"))
    )


def promote_code_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """As above for snippets; the page URL only where it differs from the URL, empty values are NULL."""
    key = lambda k: F.nullif(F.try_element_at(F.col(metadata), F.lit(k)), F.lit(""))
    page = key("page_url")
    out = df.withColumn("page_url", F.when(~page.eqNullSafe(F.col("url")), page))
    for name in ("source_type", "base_url", "source_title"):
        out = out.withColumn(name, key(name))
    return out


def display_summary(summary: Column, content: Column) -> Column:
    """The summary, or the first 150 characters of the content."""
    return F.coalesce(F.nullif(summary, F.lit("")), _cut(F.coalesce(content, F.lit("")), SUMMARY_CUT))


def compact(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Short form of chunk results, with the size and preview of each snippet."""
    info = lambda s: F.struct(
        s["id"].alias("id"),
        F.when(F.coalesce(s["content"], F.lit("")) == "", 0).otherwise(filled_line_count(s["content"])).alias("lines"),
        F.length(F.coalesce(s["content"], F.lit(""))).alias("chars"),
        F.coalesce(s["preview"], F.lit("")).alias("preview"),
    )
    summary = F.col("summary") if "summary" in df.columns else F.lit(None).cast("string")
    return df.select(
        id_col,
        "doc_id",
        "title",
        display_summary(summary, F.col("content")).alias("summary"),
        "score",
        "url",
        F.size("code_snippets").alias("code_snippets_count"),
        F.transform("code_snippets", info).alias("code_snippet_ids"),
    )


def compact_code(df: DataFrame, id_col: str = "snippet_id") -> DataFrame:
    """Short form of code results; the line count is that of the cut text."""
    cut = _cut(F.coalesce("content", F.lit("")), CODE_CUT)
    return df.select(
        id_col, "doc_id", cut.alias("content"), "score", "url", line_count(cut).alias("line_count")
    )


def result_envelope(results: DataFrame, query: str, mode: str) -> DataFrame:
    """One row: number of results, query and mode."""
    return results.agg(F.count("*").alias("total")).select("total", F.lit(query).alias("query"), F.lit(mode).alias("mode"))
