"""Pages and files into the corpus: snippets, placeholder text, chunks, vectors, titles, tables.

Everything up to the chunks is a narrow transformation of one row per document. The result is written once and read
back for each target table, so nothing is computed twice and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.functions.patterns import is_blank, let
from doclake.functions.summaries import LeadSummarizer, Summarizer, title_and_summary
from doclake.functions.vectors import Embedder, code_embedder, embed, text_embedder
from doclake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_spans, chunks_of, renumber
from doclake.operators.documents import latest_documents, with_chunk_counts
from doclake.operators.quality import WORD_COUNT_THRESHOLD, quality_enough, score_pages
from doclake.operators.snippets import links_within, placeholder_spans, placeholder_text, snippet_array
from doclake.session import discard, shared_dir, spread, stored
from doclake.sources.corpus import Corpus
from doclake.sources.pages import pages_to_markdown


def documents_from_pages(
    pages: DataFrame, threshold: int = WORD_COUNT_THRESHOLD, keywords: list[str] | None = None
) -> DataFrame:
    """Fetched pages (url, html) to cleaned documents (url, title, content, metadata, error).

    A page that could not be converted or holds too little text keeps its row, without content and with an error.
    """
    parsed = pages_to_markdown(pages)
    error = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("page could not be converted: "), F.col("error")))
        .when(F.col("markdown").isNull(), "page has no html")
        .when(~quality_enough("markdown", threshold), "page has too little text")
    )
    judged = parsed.withColumn("error", error).withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown")))
    scored = score_pages(judged, keywords)
    metadata = F.create_map(
        F.lit("length"),
        F.col("length").cast("string"),
        F.lit("relevance_score"),
        F.col("relevance_score").cast("string"),
        F.lit("source_type"),
        F.lit("crawl"),
    )
    return scored.select("url", "title", "content", metadata.alias("metadata"), "error")


def prepare_documents(
    df: DataFrame,
    context: str | Column,
    source_type: str = "url",
    now: datetime | Column | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    mode: str = "exact",
) -> DataFrame:
    """Documents (url, title, content, metadata) with their snippets, placeholder text and chunks, one row each.

    A document without URL or content, or with an ``error`` of its own, keeps its row with status "failed" and an error.
    """
    schema.check_choice(source_type, schema.SOURCE_TYPES, "source type")
    moment = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    none = F.lit(None).cast("map<string,string>")
    own = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    error = (
        F.when(F.col("url").isNull() | (F.col("url") == ""), "document has no url")
        .when(own.isNotNull(), own)
        .when(F.col("content").isNull() | is_blank("content"), "document has no content")
    )
    rows = df.select(
        (F.lit(context) if isinstance(context, str) else context).alias("context_id"),
        "url",
        "title",
        "content",
        (F.col("metadata").cast("map<string,string>") if "metadata" in df.columns else none).alias("metadata"),
        (F.col("indexed_at") if "indexed_at" in df.columns else moment).alias("indexed_at"),
        F.lit(source_type).alias("source_type"),
        error.alias("error"),
    )
    keyed = latest_documents(rows.withColumn("title", F.coalesce("title", "url", F.lit("Untitled"))))
    found = keyed.withColumn("snippets", snippet_array("content", "doc_id"))
    replaced = found.withColumnRenamed("content", "raw_content").withColumn(
        "content", placeholder_text("raw_content", "snippets", mode)
    )
    wanted = F.when(F.col("error").isNull(), F.col("content"))
    cut = replaced.withColumn("_spans", chunk_spans(wanted, size, overlap))

    def linked(spans: Column) -> Column:
        def record(c: Column) -> Column:
            fields = ["chunk_index", "content", "tokens", "start_line", "end_line", "char_start", "char_end", "metadata"]
            links = links_within(spans, c["char_start"], c["char_end"])
            return F.struct(*[c[f].alias(f) for f in fields], links.alias("code_snippet_ids"))

        return F.transform(chunks_of("content", "_spans", overlap), record)

    status = F.when(F.col("error").isNull(), "processed").otherwise("failed")
    return (
        cut.withColumn("chunks", let(placeholder_spans("content"), linked)).drop("_spans").withColumn("status", status)
    )


def chunk_rows(
    prepared: DataFrame, embedder: Embedder, summarizer: Summarizer, now: datetime | Column | None = None
) -> DataFrame:
    """One row per chunk with vector, title and summary."""
    moment = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    rows = prepared.where(F.col("status") == "processed").select("context_id", "doc_id", F.explode("chunks").alias("_c"))
    rows = rows.select("context_id", "doc_id", "_c.*", moment.alias("created_at"))
    rows = rows.withColumn("embedding", embed("content", embedder))
    rows = rows.withColumn("_t", title_and_summary("content", summarizer))
    rows = rows.select("*", "_t.title", "_t.summary", "_t.summary_model").drop("_t")
    return rows.withColumn("chunk_id", schema.chunk_id("doc_id", "chunk_index"))


def snippet_rows(prepared: DataFrame, embedder: Embedder, now: datetime | Column | None = None) -> DataFrame:
    """One row per snippet with vector; a snippet whose vector failed is kept with NULL and found by text only."""
    moment = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    rows = prepared.where(F.col("status") == "processed").select("context_id", "doc_id", F.explode("snippets").alias("_s"))
    rows = rows.select("context_id", "doc_id", "_s.*", moment.alias("created_at"))
    metadata = F.create_map(
        F.lit("snippet_type"),
        F.col("snippet_type"),
        F.lit("start_pos"),
        F.col("start_pos").cast("string"),
        F.lit("end_pos"),
        F.col("end_pos").cast("string"),
    )
    return rows.withColumn("embedding", embed("content", embedder)).withColumn("metadata", metadata)


def store_processed(
    corpus: Corpus,
    name: str,
    df: DataFrame,
    source_type: str = "url",
    embedder: Embedder | None = None,
    snippet_embedder: Embedder | None = None,
    summarizer: Summarizer | None = None,
    now: datetime | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    mode: str = "exact",
) -> DataFrame:
    """Store documents with everything derived from them; a document stored before gives up all its old children.

    Returns one row per document (url, title, status, error, chunks, snippets), the input of ``run_summary``.
    """
    spark = corpus.spark
    context = corpus.context_id(name)
    embedder = embedder or text_embedder()
    corpus.use_model(name, getattr(embedder, "name", type(embedder).__name__))
    moment = now or datetime.now()
    work = shared_dir(spark, "ingest")

    prepare_documents(df, context, source_type, moment, size, overlap, mode).write.parquet(f"{work}/documents")
    prepared = spread(spark.read.parquet(f"{work}/documents"))
    done = prepared.where(F.col("status") == "processed")

    rows = chunk_rows(prepared, embedder, summarizer or LeadSummarizer(), moment)
    rows.write.parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    if chunks.where(F.col("embedding").isNull()).limit(1).count():
        chunks = renumber(chunks).withColumn("chunk_id", schema.chunk_id("doc_id", "chunk_index"))
    snippet_rows(prepared, snippet_embedder or code_embedder(), moment).write.parquet(f"{work}/snippets")
    snippets = spark.read.parquet(f"{work}/snippets")

    raw = done.select("context_id", "doc_id", "raw_content", F.col("indexed_at").alias("created_at"))
    kept = ["context_id", "url", "title", "content", "metadata", "indexed_at", "source_type", "doc_id"]
    # One version: readers see a document's new text, chunks and snippets together or none of them.
    documents = with_chunk_counts(done.select(*kept), chunks)
    corpus.replace_whole({"code_snippets": snippets, "chunks": chunks, "raw_documents": raw, "documents": documents})

    summary = with_chunk_counts(prepared, chunks).select(
        "url", "title", "status", "error", F.col("chunk_count").alias("chunks"), F.size("snippets").alias("snippets")
    )
    out = stored(summary, "ingest-summary")
    discard(spark, work)
    return out
