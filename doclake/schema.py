"""Corpus tables and their deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.urls import url_key

CHUNK_METADATA = "struct<chunk_index:int,chunk_type:string,chunk_size:int,chunk_overlap:int,error:string>"

TABLES = {
    "contexts": (
        "context_id string, name string, description string, embedding_model string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "documents": (
        "context_id string, doc_id string, url string, title string, content string, "
        "metadata map<string,string>, indexed_at timestamp, source_type string, chunk_count int, "
        "content_length int, content_bytes long"
    ),
    "raw_documents": "context_id string, doc_id string, raw_content string, created_at timestamp",
    "chunks": (
        "context_id string, doc_id string, chunk_id string, content string, title string, summary string, "
        "summary_model string, embedding array<float>, chunk_index int, code_snippet_ids array<string>, "
        f"metadata {CHUNK_METADATA}, tokens int, start_line int, end_line int, char_start int, char_end int, "
        "created_at timestamp"
    ),
    "code_snippets": (
        "context_id string, doc_id string, snippet_id string, content string, embedding array<float>, "
        "snippet_type string, start_pos int, end_pos int, line_count int, char_count int, preview string, "
        "metadata map<string,string>, created_at timestamp"
    ),
    "job_events": (
        "event_id string, job_id string, type string, context_id string, status string, progress double, "
        "metadata map<string,string>, error_message string, result_data string, ts timestamp"
    ),
}

#: Sizes of a stored document's text, written with it so that no look-up or listing has to read the text.
DOCUMENT_SIZES = {"content_length": lambda: F.length("content"), "content_bytes": lambda: F.octet_length("content").cast("long")}


def text_size(documents, size: str) -> Column:
    """A size from the stored column where there is one, otherwise from the text."""
    return F.col(size) if size in documents.columns else DOCUMENT_SIZES[size]()


DEFAULT_EMBEDDING_MODEL = "text-embedding-3-large"
SOURCE_TYPES = ("url", "file")
SEARCH_MODES = ("vector", "fulltext", "hybrid")
MERGE_MODES = ("union", "intersection")


def check_choice(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def _digest(*parts) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def context_id(name) -> Column:
    return _digest(name)


def document_id(context, url) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return _digest(context, F.coalesce(url_key(url), F.lit("")))


def chunk_id(doc, index) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return _digest(doc, index.cast("string"))


def snippet_id(doc, start_pos, snippet_type) -> Column:
    start_pos = F.col(start_pos) if isinstance(start_pos, str) else start_pos
    return _digest(doc, start_pos.cast("string"), snippet_type)
