"""Documents, raw documents, chunks and snippets as stored rows: upsert, list, delete, look up, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.functions.urls import url_key
from doclake.operators.relations import first_per_key, upsert, with_ids

PAGE_SIZE = 25_000
TOOL_PAGE_SIZE = 20_000


def latest_documents(incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per (context, URL key), the latest, with its id; the URL is stored without trailing slashes."""
    keyed = incoming.withColumn("url", url_key("url")).withColumn("doc_id", schema.document_id("context_id", "url"))
    return first_per_key(keyed, ["doc_id"], order or [F.desc("indexed_at"), F.desc(F.xxhash64("title", "content"))])


def upsert_documents(existing: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Documents after an upsert on (context, URL key): everything is replaced but the id and the source type."""
    return upsert(existing, latest_documents(incoming, order), ["doc_id"], keep=("source_type",))


def latest_raw(incoming: DataFrame) -> DataFrame:
    return first_per_key(incoming, ["doc_id"], [F.desc("created_at"), F.desc(F.xxhash64("raw_content"))])


def upsert_raw(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, latest_raw(incoming), ["doc_id"])


def latest_chunks(incoming: DataFrame) -> DataFrame:
    keys = ["doc_id", "chunk_index"]
    return first_per_key(incoming, keys, [F.desc("created_at"), F.desc(F.xxhash64("content"))])


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after an upsert on (document, chunk index)."""
    return upsert(existing, latest_chunks(incoming), ["doc_id", "chunk_index"])


def list_documents(documents: DataFrame, context_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a context's documents, newest first; no content is read."""
    columns = [c for c in documents.columns if c not in ("content", "context_id", *schema.DOCUMENT_SIZES)]
    own = documents.where(F.col("context_id") == context_id).select(*columns)
    return own.orderBy(F.desc("indexed_at"), "doc_id").offset(offset).limit(limit)


def count_documents(documents: DataFrame, context_id: str) -> DataFrame:
    return documents.where(F.col("context_id") == context_id).agg(F.count("*").alias("total"))


def delete_documents(documents: DataFrame, context_id: str, ids: DataFrame) -> DataFrame:
    """Documents left after deleting the listed ids from one context."""
    gone = ids.select(F.col(ids.columns[0]).alias("doc_id"), F.lit(context_id).alias("context_id"))
    return documents.join(gone, ["context_id", "doc_id"], "left_anti").select(*documents.columns)


def deleted_count(documents: DataFrame, context_id: str, ids: DataFrame) -> DataFrame:
    own = with_ids(documents.where(F.col("context_id") == context_id), ids, "doc_id")
    return own.agg(F.count("*").alias("deleted"))


def get_documents(
    documents: DataFrame, ids, raw_documents: DataFrame | None = None, context_id: str | None = None
) -> DataFrame:
    """Documents by id, cleaned, or with their raw content when ``raw_documents`` is given."""
    chosen = documents if context_id is None else documents.where(F.col("context_id") == context_id)
    chosen = with_ids(chosen, ids, "doc_id")
    kind = F.lit("cleaned" if raw_documents is None else "raw").alias("document_type")
    if raw_documents is None:
        return chosen.withColumn("content", F.coalesce("content", F.lit(""))).select("*", kind)
    raw = with_ids(raw_documents.select("doc_id", "raw_content"), ids, "doc_id")
    joined = chosen.drop("content").join(raw, "doc_id", "left")
    return joined.withColumn("content", F.coalesce("raw_content", F.lit(""))).drop("raw_content").select("*", kind)


def page_content(df: DataFrame, page_size: int = PAGE_SIZE, page: int | None = None) -> DataFrame:
    """Character pages of ``content``: one page number for all rows, or every page of every row.

    A page past the end has NULL content and an error text.
    """
    if page_size < 1 or (page is not None and page < 1):
        raise ValueError("page and page size start at 1")
    length = F.length("content")
    sized = df.withColumn("full_content_length", length).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(length / page_size)).cast("int")
    )
    number = F.explode(F.sequence(F.lit(1), F.col("total_pages"))) if page is None else F.lit(page)
    paged = sized.withColumn("page_number", number.cast("int") if page is not None else number)
    inside = F.col("page_number") <= F.col("total_pages")
    piece = F.substring("content", (F.col("page_number") - 1) * page_size + 1, F.lit(page_size))
    message = F.concat(
        F.lit("Page "), F.col("page_number"), F.lit(" not found. Document has "), F.col("total_pages"), F.lit(" pages.")
    )
    return (
        paged.withColumn("content", F.when(inside, piece))
        .withColumn("current_page_length", F.coalesce(F.length("content"), F.lit(0)))
        .withColumn("has_next_page", F.col("page_number") < F.col("total_pages"))
        .withColumn("has_previous_page", F.col("page_number") > 1)
        .withColumn("content_truncated", F.col("full_content_length") > page_size)
        .withColumn("page_error", F.when(~inside, message))
    )


def with_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return documents.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def with_document_counts(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """Contexts with their number of documents."""
    counts = documents.groupBy("context_id").agg(F.count("*").cast("int").alias("document_count"))
    return contexts.join(counts, "context_id", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0))
    )


def refresh_counts(contexts: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts and documents with fresh counts."""
    return with_document_counts(contexts, documents), with_chunk_counts(documents, chunks)


def attach_snippets(
    rows: DataFrame,
    snippets: DataFrame,
    fields: tuple[str, ...] = ("content", "preview"),
    links_from: DataFrame | None = None,
) -> DataFrame:
    """Rows (chunk_id, code_snippet_ids, ...) with an array of snippet structs, in link order; one join for all rows.

    ``rows`` is read twice. Where it is costly, ``links_from`` names a cheaper frame with the same chunks.
    """
    source = rows if links_from is None else links_from
    links = source.select("chunk_id", F.posexplode("code_snippet_ids").alias("_pos", "snippet_id"))
    own = snippets.select("snippet_id", F.struct(F.col("snippet_id").alias("id"), *fields).alias("_snippet"))
    nested = (
        links.join(own, "snippet_id")
        .groupBy("chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_snippet")))["_snippet"].alias("code_snippets"))
    )
    empty = F.array().cast(nested.schema["code_snippets"].dataType)
    joined = rows.join(nested, "chunk_id", "left")
    return joined.withColumn("code_snippets", F.coalesce("code_snippets", empty))


def _document_fields(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.col("title").alias("doc_title"),
        F.col("url").alias("doc_url"),
        F.col("metadata").alias("doc_metadata"),
        schema.text_size(documents, "content_length").alias("parent_page_size"),
    )


def chunk_details(
    chunks: DataFrame, documents: DataFrame, snippets: DataFrame, ids, context_id: str | None = None
) -> DataFrame:
    """Chunks by id with fields of their document, the document's chunk total, and their snippets."""
    chosen = with_ids(chunks.drop("embedding"), ids, "chunk_id")
    if context_id is not None:
        chosen = chosen.where(F.col("context_id") == context_id)
    siblings = chunks.select("doc_id").join(chosen.select("doc_id"), "doc_id", "left_semi")
    totals = siblings.groupBy("doc_id").agg(F.count("*").cast("int").alias("parent_total_chunks"))
    detailed = chosen.join(_document_fields(documents), "doc_id").join(totals, "doc_id")
    return attach_snippets(detailed, snippets, ("content", "snippet_type", "preview"), links_from=chosen)


def snippet_details(snippets: DataFrame, documents: DataFrame, ids, context_id: str | None = None) -> DataFrame:
    """Snippets by id with title and URL of their document."""
    chosen = with_ids(snippets.drop("embedding"), ids, "snippet_id")
    if context_id is not None:
        chosen = chosen.where(F.col("context_id") == context_id)
    names = documents.select("doc_id", F.col("title").alias("document_title"), F.col("url").alias("document_url"))
    joined = chosen.join(names, "doc_id")
    return joined.withColumn("preview", F.coalesce("preview", F.lit(""))).fillna(0, ["line_count", "char_count"])
