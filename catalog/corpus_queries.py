"""Corpus administration, merge, ledger, source, sink and streaming queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.registry import DOCS_SQL, corpus_documents, markdown_documents, query, table
from catalog.text_queries import _SNIPPETS_SQL
from doclake import schema
from doclake.functions.vectors import HashEmbedder
from doclake.operators import contexts as C
from doclake.operators import documents as D
from doclake.operators import ledger as L
from doclake.operators import merge as M
from doclake.plans.ingest import store_processed
from doclake.plans.merging import merge_contexts
from doclake.session import shared_dir
from doclake.sources import bundle
from doclake.sources.corpus import Corpus
from doclake.sources.files import file_report, read_directory, read_files
from doclake.streaming.ingest import ingest_stream, page_stream
from doclake.streaming.ledger import ledger_stream, read_state

_NOW = datetime(2024, 2, 1)

# Frames derived from the tables ---------------------------------------------------------------------------------------


def context_frame(spark, sf) -> DataFrame:
    """Sources as contexts, created when their first document appears."""
    firsts = corpus_documents(spark, sf).groupBy("context_id").agg(F.min("indexed_at").alias("created_at"))
    return firsts.select(
        "context_id",
        F.col("context_id").alias("name"),
        F.lit("").alias("description"),
        F.lit(schema.DEFAULT_EMBEDDING_MODEL).alias("embedding_model"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def chunk_frame(spark, sf) -> DataFrame:
    """Fixed-size pieces of 1000 characters as chunks."""
    d = corpus_documents(spark, sf).where(F.length("content") > 0)
    last = F.floor((F.length("content") + 999) / 1000) - 1
    parts = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    piece = F.substring("content", (F.col("i") * 1000 + 1).cast("int"), F.lit(1000))
    return parts.select(
        F.concat_ws("-", "doc_id", "i").alias("chunk_id"),
        "doc_id",
        "context_id",
        F.col("i").cast("int").alias("chunk_index"),
        piece.alias("content"),
        F.floor(F.length(piece) / 4).cast("int").alias("tokens"),
        F.array(F.concat_ws("/", "doc_id", "i"), F.lit("gone")).alias("code_snippet_ids"),
        F.array(F.lit(0.5)).cast("array<float>").alias("embedding"),
        F.col("indexed_at").alias("created_at"),
    )


_CHUNKS_SQL = f"""
{DOCS_SQL}, ch AS (
  SELECT doc_id || '-' || i AS chunk_id, doc_id, context_id, CAST(i AS INT) AS chunk_index,
    substr(content, i * 1000 + 1, 1000) AS content, CAST(length(substr(content, i * 1000 + 1, 1000)) // 4 AS INT) AS tokens,
    indexed_at AS created_at FROM docs, unnest(range(0, (length(content) + 999) // 1000)) AS u(i)
)
"""


def snippet_frame(spark, sf) -> DataFrame:
    """Every chunk as a snippet."""
    c = chunk_frame(spark, sf)
    return c.select(
        F.concat_ws("/", "doc_id", "chunk_index").alias("snippet_id"),
        "doc_id",
        "context_id",
        "content",
        F.lit("code_block").alias("snippet_type"),
        (F.col("chunk_index") * 1000).alias("start_pos"),
        F.left("content", F.lit(10)).alias("preview"),
        F.array(F.lit(0.5)).cast("array<float>").alias("embedding"),
        F.lit(None).cast("int").alias("line_count"),
        F.length("content").alias("char_count"),
    )


_SNIPS_SQL = """
sn AS (SELECT doc_id || '/' || chunk_index AS snippet_id, doc_id, context_id, content,
       'code_block' AS snippet_type, chunk_index * 1000 AS start_pos, substr(content, 1, 10) AS preview FROM ch)
"""

# Contexts -------------------------------------------------------------------------------------------------------------


@query(
    "register_contexts",
    f"""
    WITH {DOCS_SQL}, names AS (SELECT DISTINCT context_id AS name FROM docs UNION SELECT 'new-' || context_id FROM docs
      UNION SELECT repeat('x', 101) || context_id FROM docs)
    SELECT sha256(name) AS context_id, name, CASE WHEN length(name) > 100 THEN 'invalid' WHEN name LIKE 'src%'
      THEN 'exists' ELSE 'created' END AS status FROM names
    """,
)
def _register_contexts(spark, sf):
    known = corpus_documents(spark, sf).select(F.col("context_id").alias("name")).distinct()
    stored = known.select(schema.context_id("name").alias("context_id"))
    incoming = known.unionByName(known.select(F.concat(F.lit("new-"), "name").alias("name"))).unionByName(
        known.select(F.concat(F.lit("x" * 101), "name").alias("name"))
    )
    return C.register_contexts(stored, incoming, _NOW).select("context_id", "name", "status")


@query(
    "list_contexts",
    f"""
    WITH {DOCS_SQL} SELECT context_id AS name, count(*) AS document_count, round(sum(strlen(content)) / 1048576.0, 6) AS size_mb
    FROM docs GROUP BY context_id
    """,
)
def _list_contexts(spark, sf):
    out = C.list_contexts(context_frame(spark, sf), corpus_documents(spark, sf))
    return out.select("name", "document_count", "size_mb")


@query(
    "delete_context",
    f"""
    WITH {_CHUNKS_SQL}, {_SNIPS_SQL} SELECT 'documents' AS name, count(*) AS n FROM docs WHERE context_id <> 'src2'
    UNION ALL SELECT 'chunks', count(*) FROM ch WHERE context_id <> 'src2'
    UNION ALL SELECT 'code_snippets', count(*) FROM sn WHERE context_id <> 'src2'
    """,
)
def _delete_context(spark, sf):
    tables = {
        "documents": corpus_documents(spark, sf),
        "chunks": chunk_frame(spark, sf),
        "code_snippets": snippet_frame(spark, sf),
    }
    parts = [C.delete_context(df, "src2").select(F.lit(n).alias("name")) for n, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "corpus_stats",
    f"""
    WITH {_CHUNKS_SQL}, {_SNIPS_SQL}, d AS (SELECT context_id, count(*) AS documents FROM docs GROUP BY 1),
      c AS (SELECT context_id, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM ch GROUP BY 1),
      s AS (SELECT context_id, count(*) AS code_snippets FROM sn GROUP BY 1)
    SELECT d.context_id AS name, documents, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens,
      coalesce(code_snippets, 0) AS code_snippets FROM d LEFT JOIN c USING (context_id) LEFT JOIN s USING (context_id)
    """,
)
def _corpus_stats(spark, sf):
    out = C.corpus_stats(
        context_frame(spark, sf), corpus_documents(spark, sf), chunk_frame(spark, sf), snippet_frame(spark, sf)
    )
    return out.drop("context_id")


# Documents ------------------------------------------------------------------------------------------------------------


def _stored_and_new(spark, sf):
    """The first version of every English document is stored; all documents then arrive, the last of a URL winning."""
    d = corpus_documents(spark, sf).withColumn("doc_no", F.col("doc_id"))
    columns = ["context_id", "url", "title", "content", "indexed_at", "source_type", "doc_no"]
    stored = d.where(F.col("lang") == "en").withColumn("source_type", F.lit("file"))
    stored = D.latest_documents(stored.select(*columns), [F.col("doc_no")])
    incoming = d.withColumn("source_type", F.lit("url")).withColumn("url", F.concat("url", F.lit("/")))
    return stored, incoming.select(*columns)


@query(
    "upsert_documents",
    f"""
    WITH {DOCS_SQL}, last AS (SELECT context_id, url, max_by(title, doc_id) AS title, max(doc_id) AS doc_no,
      bool_or(lang = 'en') AS known FROM docs GROUP BY context_id, url)
    SELECT sha256(concat_ws(chr(1), context_id, url)) AS doc_id, url, title, doc_no,
      CASE WHEN known THEN 'file' ELSE 'url' END AS source_type FROM last
    """,
)
def _upsert_documents(spark, sf):
    stored, incoming = _stored_and_new(spark, sf)
    out = D.upsert_documents(stored, incoming, [F.desc("doc_no")])
    return out.select("doc_id", "url", "title", "doc_no", "source_type")


@query(
    "upsert_raw_documents",
    f"""
    WITH {DOCS_SQL} SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN 'v2 ' || content ELSE content END) AS digest FROM docs
    """,
)
def _upsert_raw(spark, sf):
    d = corpus_documents(spark, sf)
    stored = d.select("doc_id", F.col("content").alias("raw_content"), F.col("indexed_at").alias("created_at"))
    fresh = d.where(F.col("lang") == "fr").select(
        "doc_id", F.concat(F.lit("v2 "), "content").alias("raw_content"), F.lit(_NOW).alias("created_at")
    )
    return D.upsert_raw(stored, fresh).select("doc_id", F.md5("raw_content").alias("digest"))


@query(
    "upsert_chunks",
    f"""
    WITH {_CHUNKS_SQL} SELECT chunk_id, CASE WHEN chunk_index >= 2 THEN 'v2 ' || content ELSE content END AS content FROM ch
    UNION ALL SELECT 'new-' || doc_id, 'extra' FROM docs
    """,
)
def _upsert_chunks(spark, sf):
    stored = chunk_frame(spark, sf).select("chunk_id", "doc_id", "chunk_index", "content", "created_at")
    later = F.lit(_NOW).alias("created_at")
    changed = stored.where(F.col("chunk_index") >= 2).select(
        "chunk_id", "doc_id", "chunk_index", F.concat(F.lit("v2 "), "content").alias("content"), later
    )
    extra = corpus_documents(spark, sf).select(
        F.concat(F.lit("new-"), "doc_id").alias("chunk_id"), "doc_id", F.lit(-1).alias("chunk_index"), F.lit("extra").alias("content"), later
    )
    return D.upsert_chunks(stored, changed.unionByName(extra)).select("chunk_id", "content")


@query(
    "list_documents",
    f"""
    WITH {DOCS_SQL} SELECT doc_id, title, url FROM docs WHERE context_id = 'src4' ORDER BY indexed_at DESC, doc_id
    LIMIT 20 OFFSET 5
    """,
)
def _list_documents(spark, sf):
    return D.list_documents(corpus_documents(spark, sf), "src4", 5, 20).select("doc_id", "title", "url")


@query("count_documents", f"WITH {DOCS_SQL} SELECT count(*) AS total FROM docs WHERE context_id = 'src4'")
def _count_documents(spark, sf):
    return D.count_documents(corpus_documents(spark, sf), "src4")


@query(
    "delete_documents",
    f"""
    WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE NOT (context_id = 'src1' AND doc_id IN (SELECT doc_id FROM labels))
    """,
)
def _delete_documents(spark, sf):
    ids = table(spark, sf, "labels").select("doc_id")
    return D.delete_documents(corpus_documents(spark, sf), "src1", ids).select("doc_id")


@query(
    "deleted_count",
    f"WITH {DOCS_SQL} SELECT count(*) AS deleted FROM docs WHERE context_id = 'src1' AND doc_id IN (SELECT doc_id FROM labels)",
)
def _deleted_count(spark, sf):
    return D.deleted_count(corpus_documents(spark, sf), "src1", table(spark, sf, "labels").select("doc_id"))


@query(
    "get_documents_raw",
    f"""
    WITH {DOCS_SQL} SELECT doc_id, CASE WHEN lang = 'en' THEN md5('raw ' || content) ELSE md5('') END AS digest,
      'raw' AS document_type FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)
    """,
)
def _get_documents_raw(spark, sf):
    d = corpus_documents(spark, sf)
    raw = d.where(F.col("lang") == "en").select("doc_id", F.concat(F.lit("raw "), "content").alias("raw_content"))
    out = D.get_documents(d, table(spark, sf, "labels").select("doc_id"), raw)
    return out.select("doc_id", F.md5("content").alias("digest"), "document_type")


@query(
    "get_documents",
    f"""
    WITH {DOCS_SQL} SELECT doc_id, title, md5(content) AS digest, 'cleaned' AS document_type FROM docs
    WHERE context_id = 'src6' AND doc_id IN (SELECT doc_id FROM labels)
    """,
)
def _get_documents(spark, sf):
    ids = table(spark, sf, "labels").select("doc_id")
    out = D.get_documents(corpus_documents(spark, sf), ids, context_id="src6")
    return out.select("doc_id", "title", F.md5("content").alias("digest"), "document_type")


@query(
    "char_paging",
    f"""
    WITH {DOCS_SQL}, n AS (SELECT *, greatest(1, (length(content) + 999) // 1000) AS pages FROM docs)
    SELECT doc_id, CAST(p AS INT) AS page_number, CAST(pages AS INT) AS total_pages,
      md5(substr(content, (p - 1) * 1000 + 1, 1000)) AS digest, length(content) AS full_content_length,
      CAST(p < pages AS INT) AS has_next, CAST(p > 1 AS INT) AS has_previous, CAST(length(content) > 1000 AS INT) AS truncated
    FROM n, unnest(range(1, pages + 1)) AS u(p)
    """,
)
def _char_paging(spark, sf):
    out = D.page_content(corpus_documents(spark, sf), 1000)
    return out.select(
        "doc_id",
        "page_number",
        "total_pages",
        F.md5("content").alias("digest"),
        "full_content_length",
        F.col("has_next_page").cast("int").alias("has_next"),
        F.col("has_previous_page").cast("int").alias("has_previous"),
        F.col("content_truncated").cast("int").alias("truncated"),
    )


@query(
    "one_page",
    f"""
    WITH {DOCS_SQL}, n AS (SELECT *, greatest(1, (length(content) + 999) // 1000) AS pages FROM docs)
    SELECT doc_id, CASE WHEN pages >= 2 THEN substr(content, 1001, 1000) END AS content,
      CASE WHEN pages < 2 THEN 'Page 2 not found. Document has ' || pages || ' pages.' END AS page_error FROM n
    """,
)
def _one_page(spark, sf):
    return D.page_content(corpus_documents(spark, sf), 1000, 2).select("doc_id", "content", "page_error")


@query(
    "chunk_counts",
    f"""
    WITH {_CHUNKS_SQL} SELECT d.doc_id, CAST(count(c.chunk_id) AS INT) AS chunk_count FROM docs d
    LEFT JOIN ch c ON c.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def _chunk_counts(spark, sf):
    out = D.with_chunk_counts(corpus_documents(spark, sf), chunk_frame(spark, sf))
    return out.select("doc_id", "chunk_count")


@query(
    "document_counts",
    f"WITH {DOCS_SQL} SELECT context_id AS name, CAST(count(*) AS INT) AS document_count FROM docs GROUP BY context_id",
)
def _document_counts(spark, sf):
    out = D.with_document_counts(context_frame(spark, sf), corpus_documents(spark, sf))
    return out.select("name", "document_count")


@query(
    "chunk_details",
    f"""
    WITH {_CHUNKS_SQL}, {_SNIPS_SQL} SELECT c.chunk_id, d.title AS doc_title, d.url AS doc_url,
      length(d.content) AS parent_page_size, CAST((length(d.content) + 999) // 1000 AS INT) AS parent_total_chunks,
      s.snippet_id || ':' || s.preview AS snippets
    FROM ch c JOIN docs d USING (doc_id) JOIN sn s ON s.snippet_id = c.doc_id || '/' || c.chunk_index
    WHERE c.doc_id IN (SELECT doc_id FROM labels)
    """,
)
def _chunk_details(spark, sf):
    chunks = chunk_frame(spark, sf)
    ids = chunks.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("chunk_id")
    docs = corpus_documents(spark, sf).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    out = D.chunk_details(chunks, docs, snippet_frame(spark, sf), ids)
    flat = F.transform("code_snippets", lambda s: F.concat(s["id"], F.lit(":"), s["preview"]))
    return out.select(
        "chunk_id", "doc_title", "doc_url", "parent_page_size", "parent_total_chunks", F.array_join(flat, "|").alias("snippets")
    )


@query(
    "snippet_details",
    f"""
    WITH {_CHUNKS_SQL}, {_SNIPS_SQL} SELECT snippet_id, sn.content, d.title AS document_title, d.url AS document_url,
      CAST(0 AS INT) AS line_count FROM sn JOIN docs d USING (doc_id) WHERE d.context_id = 'src9'
      AND sn.doc_id IN (SELECT doc_id FROM labels)
    """,
)
def _snippet_details(spark, sf):
    snippets = snippet_frame(spark, sf)
    ids = snippets.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("snippet_id")
    out = D.snippet_details(snippets, corpus_documents(spark, sf), ids, "src9")
    return out.select("snippet_id", "content", "document_title", "document_url", "line_count")


# Merge ----------------------------------------------------------------------------------------------------------------

_SOURCES = ["src0", "src5", "src10"]
_TARGET = "src15"
_POSITION = "CAST(list_position(['src0', 'src5', 'src10'], context_id) AS INT) AS src_order"


@query(
    "merge_union",
    f"WITH {DOCS_SQL} SELECT doc_id, url, {_POSITION} FROM docs WHERE context_id IN ('src0', 'src5', 'src10')",
)
def _merge_union(spark, sf):
    return M.merge_union(corpus_documents(spark, sf), _SOURCES).select("doc_id", "url", "src_order")


_COMMON_SQL = """
  SELECT doc_id, url FROM docs d WHERE context_id = 'src0' AND EXISTS (SELECT 1 FROM docs x WHERE x.context_id = 'src5'
  AND x.url = d.url)
"""


@query("merge_intersection", f"WITH {DOCS_SQL} {_COMMON_SQL}")
def _merge_intersection(spark, sf):
    return M.merge_intersection(corpus_documents(spark, sf), ["src0", "src5"]).select("doc_id", "url")


_UNIQUE_SQL = f"""
{DOCS_SQL}, ordered AS (SELECT *, {_POSITION} FROM docs WHERE context_id IN ('src0', 'src5', 'src10')),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src_order, doc_id) AS n FROM ordered) WHERE n = 1)
"""


@query("url_dedupe", f"WITH {_UNIQUE_SQL} SELECT url, doc_id FROM uniq")
def _url_dedupe(spark, sf):
    return M.collect_documents(corpus_documents(spark, sf), _SOURCES).select("url", "doc_id")


def _merge_frames(spark, sf):
    """Documents with text ids, as ids are text in a corpus; the target keeps its first document of each URL."""
    docs = corpus_documents(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    docs = docs.withColumn("doc_id", F.lpad("doc_id", 12, "0"))
    held = M.dedupe_by_url(M.merge_union(docs, [_TARGET])).drop("src_order")
    return docs, held


_MAPPED_SQL = f"""
{_UNIQUE_SQL}, tgt AS (SELECT url, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS existing FROM docs WHERE context_id = 'src15' GROUP BY url),
mapped AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, doc_id AS doc_no, uniq.url, existing,
  coalesce(existing, sha256(concat_ws(chr(1), 'src15', uniq.url))) AS new_doc_id FROM uniq LEFT JOIN tgt ON tgt.url = uniq.url)
"""


@query("map_to_target", f"WITH {_MAPPED_SQL} SELECT doc_id, new_doc_id, CAST(existing IS NULL AS INT) AS is_new FROM mapped")
def _map_to_target(spark, sf):
    docs, held = _merge_frames(spark, sf)
    mapped = M.map_to_target(M.collect_documents(docs, _SOURCES), held, _TARGET)
    return mapped.select("doc_id", "new_doc_id", F.col("is_new").cast("int").alias("is_new"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))


@query(
    "copy_chunks",
    f"""
    WITH {_MAPPED_SQL}, ch AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(content, i * 1000 + 1, 1000) AS content FROM docs,
      unnest(range(0, (length(content) + 999) // 1000)) AS u(i)),
    held AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, chunk_index FROM ch)
    SELECT m.new_doc_id AS doc_id, c.chunk_index, sha256(concat_ws(chr(1), m.new_doc_id, CAST(c.chunk_index AS VARCHAR))) AS chunk_id,
      md5(c.content) AS digest FROM mapped m JOIN ch c ON c.doc_id = m.doc_no
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = m.new_doc_id AND h.chunk_index = c.chunk_index)
    """,
)
def _copy_chunks(spark, sf):
    docs, held = _merge_frames(spark, sf)
    ids = M.id_map(M.map_to_target(M.collect_documents(docs, _SOURCES), held, _TARGET))
    chunks = _keyed(chunk_frame(spark, sf))
    out = M.copy_chunks(ids, chunks, chunks.where(F.col("context_id") == _TARGET), _TARGET)
    return out.select("doc_id", "chunk_index", "chunk_id", F.md5("content").alias("digest"))


@query(
    "copy_chunks_remapped",
    f"""
    WITH {_MAPPED_SQL}, ch AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(content, i * 1000 + 1, 1000) AS content,
      (length(content) + 999) // 1000 AS n FROM docs, unnest(range(0, (length(content) + 999) // 1000)) AS u(i)),
    held AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, chunk_index FROM ch),
    new AS (SELECT m.new_doc_id AS doc_id, c.chunk_index, c.content,
        sha256(concat_ws(chr(1), m.new_doc_id, CAST(c.chunk_index * 1000 AS VARCHAR), 'code_block')) AS here,
        sha256(concat_ws(chr(1), m.new_doc_id, CAST((c.n - 1 - c.chunk_index) * 1000 AS VARCHAR), 'code_block')) AS far
      FROM mapped m JOIN ch c ON c.doc_id = m.doc_no)
    SELECT doc_id, chunk_index, here || ',gone' AS links, md5('[CODE_SNIPPET: snippet_id=' || far || ']' || content || '[CODE_SNIPPET: snippet_id='
      || here || '][CODE_SNIPPET: snippet_id=' || far || '] snippet_id=unknown') AS digest FROM new
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = new.doc_id AND h.chunk_index = new.chunk_index)
    """,
)
def _copy_chunks_remapped(spark, sf):
    """Chunks that name their own snippet and the one as far from the end, under new ids in text and links."""
    docs, held = _merge_frames(spark, sf)
    ids = M.id_map(M.map_to_target(M.collect_documents(docs, _SOURCES), held, _TARGET))
    last = Window.partitionBy("doc_id")
    named = chunk_frame(spark, sf).withColumn("_far", F.max("chunk_index").over(last) - F.col("chunk_index"))
    mark = lambda at: F.concat(F.lit("[CODE_SNIPPET: snippet_id="), F.concat_ws("/", "doc_id", at), F.lit("]"))
    text = F.concat(mark("_far"), "content", mark("chunk_index"), mark("_far"), F.lit(" snippet_id=unknown"))
    chunks = _keyed(named.withColumn("content", text).drop("_far"))
    pairs = M.snippet_id_pairs(ids, _keyed(snippet_frame(spark, sf)))
    out = M.copy_chunks(ids, chunks, chunks.where(F.col("context_id") == _TARGET), _TARGET, pairs)
    links = F.array_join("code_snippet_ids", ",")
    return out.select("doc_id", "chunk_index", links.alias("links"), F.md5("content").alias("digest"))


@query(
    "copy_snippets",
    f"""
    WITH {_MAPPED_SQL}, sn AS (SELECT doc_id, CAST(i * 1000 AS INT) AS start_pos, substr(content, i * 1000 + 1, 1000) AS content
      FROM docs, unnest(range(0, (length(content) + 999) // 1000)) AS u(i)),
    held AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, start_pos FROM sn)
    SELECT m.new_doc_id AS doc_id, s.start_pos, s.content,
      sha256(concat_ws(chr(1), m.new_doc_id, CAST(s.start_pos AS VARCHAR), 'code_block')) AS snippet_id
    FROM mapped m JOIN sn s ON s.doc_id = m.doc_no
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = m.new_doc_id AND h.start_pos = s.start_pos)
    """,
)
def _copy_snippets(spark, sf):
    docs, held = _merge_frames(spark, sf)
    ids = M.id_map(M.map_to_target(M.collect_documents(docs, _SOURCES), held, _TARGET))
    snippets = _keyed(snippet_frame(spark, sf))
    out = M.copy_snippets(ids, snippets, snippets.where(F.col("context_id") == _TARGET), _TARGET)
    return out.select("doc_id", "start_pos", "content", "snippet_id")


# Ledger ---------------------------------------------------------------------------------------------------------------


def job_events(spark, sf) -> DataFrame:
    """Events as job events: the user is the job; purchases end a job, errors fail it, clicks carry no status."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind != "click", "processing").alias("status"),
        F.when(kind != "view", F.col("value")).alias("progress"),
        F.when(kind == "error", F.col("props")).alias("error_message"),
        kind.alias("phase"),
    )


_EVENTS_SQL = """
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS job_id, ts,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN NULL ELSE 'processing' END AS status,
  CASE WHEN event_type <> 'view' THEN value END AS progress, CASE WHEN event_type = 'error' THEN props END AS error_message,
  event_type AS phase FROM events),
st AS (SELECT job_id, max_by(status, {'t': ts, 'e': event_id}) FILTER (status IS NOT NULL) AS status,
  max_by(progress, {'t': ts, 'e': event_id}) FILTER (progress IS NOT NULL) AS progress,
  max_by(error_message, {'t': ts, 'e': event_id}) FILTER (error_message IS NOT NULL) AS error_message,
  min(ts) AS started_at, max(ts) AS updated_at, max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at
  FROM ev GROUP BY job_id)
"""


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


_STAMPS = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ("started_at", "updated_at", "completed_at"))


@query("job_fold", f"WITH {_EVENTS_SQL} SELECT job_id, status, round(progress, 6) AS progress, error_message, {_STAMPS} FROM st")
def _job_fold(spark, sf):
    state = L.job_state(job_events(spark, sf))
    return state.select(
        "job_id", "status", F.round("progress", 6).alias("progress"), "error_message", _stamp("started_at"), _stamp("updated_at"), _stamp("completed_at")
    )


@query(
    "complete_jobs",
    f"""WITH {_EVENTS_SQL} SELECT event_id, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status,
    CAST(1.0 AS DOUBLE) AS progress FROM ev""",
)
def _complete_jobs(spark, sf):
    return L.complete_jobs(job_events(spark, sf)).select("event_id", "status", "progress")


@query("active_jobs", f"WITH {_EVENTS_SQL} SELECT job_id, status FROM st WHERE status NOT IN ('completed', 'failed')")
def _active_jobs(spark, sf):
    return L.active_jobs(L.job_state(job_events(spark, sf))).select("job_id", "status")


_OLD = "status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY"


@query("purge_jobs", f"WITH {_EVENTS_SQL} SELECT job_id FROM st WHERE NOT coalesce({_OLD}, false)")
def _purge_jobs(spark, sf):
    return L.purge_jobs(L.job_state(job_events(spark, sf)), datetime(2024, 1, 31), 1).select("job_id")


@query("purged_count", f"WITH {_EVENTS_SQL} SELECT count(*) AS deleted FROM st WHERE {_OLD}")
def _purged_count(spark, sf):
    return L.purged_count(L.job_state(job_events(spark, sf)), datetime(2024, 1, 31), 1)


def _results(spark, sf) -> DataFrame:
    d = corpus_documents(spark, sf)
    return d.select(
        "url",
        "title",
        F.when(F.col("lang") == "es", "failed").otherwise("processed").alias("status"),
        F.when(F.col("lang") == "es", "timeout").alias("error"),
        F.lit(2).alias("chunks"),
        F.length("title").alias("snippets"),
    )


@query(
    "run_summary",
    f"""
    WITH {DOCS_SQL} SELECT count(*) FILTER (lang <> 'es') AS documents_processed, count(*) FILTER (lang = 'es') AS documents_failed,
      CAST(sum(2) FILTER (lang <> 'es') AS BIGINT) AS total_chunks,
      CAST(sum(length(title)) FILTER (lang <> 'es') AS BIGINT) AS total_code_snippets FROM docs
    """,
)
def _run_summary(spark, sf):
    return L.run_summary(_results(spark, sf))


@query("failed_documents", f"WITH {DOCS_SQL} SELECT url, title, 'timeout' AS error FROM docs WHERE lang = 'es'")
def _failed_documents(spark, sf):
    return L.failed_documents(_results(spark, sf))


@query(
    "job_progress",
    f"""
    WITH {_EVENTS_SQL} SELECT event_id, round(0.1 + 0.7 * count(*) OVER (PARTITION BY job_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY job_id) + 1e-9, 6) AS progress FROM ev
    """,
)
def _job_progress(spark, sf):
    return L.progress(job_events(spark, sf)).select("event_id", F.round(F.col("progress") + 1e-9, 6).alias("progress"))


@query(
    "phase_timeline",
    f"""
    WITH {_EVENTS_SQL}, p AS (SELECT *, lag(phase) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev FROM ev),
      s AS (SELECT * FROM p WHERE prev IS NULL OR prev <> phase)
    SELECT event_id, job_id, phase, round((epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) - epoch_us(ts))
      / 1000000.0, 6) AS elapsed_seconds FROM s
    """,
)
def _phase_timeline(spark, sf):
    out = L.phase_timeline(job_events(spark, sf))
    return out.select("event_id", "job_id", "phase", F.round("elapsed_seconds", 6).alias("elapsed_seconds"))


@query(
    "current_phase",
    f"""
    WITH {_EVENTS_SQL} SELECT job_id, max_by(phase, {{'t': ts, 'e': event_id}}) AS phase, count(*) AS events,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS elapsed_seconds FROM ev GROUP BY job_id
    """,
)
def _current_phase(spark, sf):
    out = L.current_phase(job_events(spark, sf))
    return out.withColumn("elapsed_seconds", F.round("elapsed_seconds", 6))


# Sources and sinks ----------------------------------------------------------------------------------------------------


def text_files(spark: SparkSession, sf: str) -> str:
    """Documents as text files, one folder per source and no more than a thousand documents in a file."""
    path = shared_dir(spark, "files")
    d = table(spark, sf, "documents").select("source", "text")
    d.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path)
    return path


def _per_source(files: DataFrame) -> DataFrame:
    source = F.regexp_extract("url", r"source=(\w+)/", 1).alias("source")
    return files.groupBy(source).agg(
        F.sum("content_length").alias("chars"), F.sum("file_size").alias("bytes"), F.max("file_extension").alias("extension")
    )


_FILES_SQL = """
SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
  '.txt' AS extension FROM documents {} GROUP BY source
"""


@query("file_source", _FILES_SQL.format(""))
def _file_source(spark, sf):
    return _per_source(read_files(spark, f"{text_files(spark, sf)}/*/*.txt"))


@query("directory_source", _FILES_SQL.format("WHERE source NOT LIKE 'src1%'"))
def _directory_source(spark, sf):
    files = read_directory(spark, text_files(spark, sf), ["*.txt"], ["source=src1*", "*.crc"], max_files=None)
    return _per_source(files)


@query(
    "file_report",
    """
    SELECT count(*) FILTER (lang IN ('en', 'fr')) AS processed_files, count(*) FILTER (lang NOT IN ('en', 'fr')) AS failed_files,
      count(*) FILTER (lang = 'es') AS skipped_files, count(*) AS total_files FROM documents
    """,
)
def _file_report(spark, sf):
    status = F.when(F.col("lang").isin("en", "fr"), "processed").when(F.col("lang") == "es", "skipped").otherwise("failed")
    return file_report(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), status.alias("status")))


def _new_corpus(spark, sf) -> Corpus:
    """A corpus below the shared folder with every source as a context."""
    corpus = Corpus(spark, shared_dir(spark, "corpus"), buckets=2)
    names = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    corpus.register(names, _NOW)
    return corpus


_CORPORA: dict[tuple[str, str], Corpus] = {}


def filled_corpus(spark, sf) -> Corpus:
    """Documents, chunks and snippets of every source, stored once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CORPORA:
        _CORPORA[key] = _fill(_new_corpus(spark, sf), sf)
    return _CORPORA[key]


def _fill(corpus: Corpus, sf: str) -> Corpus:
    spark = corpus.spark
    owner = schema.context_id("context_id").alias("context_id")
    docs = corpus_documents(spark, sf).select("doc_id", owner, F.concat("url", F.lit("-"), "doc_id").alias("url"), "title", "content", "indexed_at", F.lit("file").alias("source_type"))
    corpus.append("documents", docs)
    corpus.append("chunks", chunk_frame(spark, sf).withColumn("context_id", owner))
    corpus.append("code_snippets", snippet_frame(spark, sf).withColumn("context_id", owner))
    return corpus


@query(
    "corpus_sink",
    f"WITH {DOCS_SQL} SELECT context_id AS name, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars FROM docs GROUP BY 1",
)
def _corpus_sink(spark, sf):
    corpus = filled_corpus(spark, sf)
    sized = corpus.read("documents").groupBy("context_id").agg(
        F.count("*").alias("documents"), F.sum(F.length("content")).alias("chars")
    )
    sources = corpus.read("contexts").where(F.col("name").startswith("src"))
    return sources.join(sized, "context_id").select("name", "documents", "chars")


@query(
    "export_manifest",
    f"""
    WITH {_CHUNKS_SQL} SELECT 'src0' AS name, '1.0' AS schema_version,
      (SELECT count(*) FROM docs WHERE context_id = 'src0') AS total_documents,
      (SELECT count(*) FROM ch WHERE context_id = 'src0') AS total_chunks,
      (SELECT count(*) FROM ch WHERE context_id = 'src0') AS total_code_snippets
    """,
)
def _export_manifest(spark, sf):
    corpus = filled_corpus(spark, sf)
    out = bundle.export_context(corpus, "src0", shared_dir(spark, "bundle"), now=_NOW)
    return out.select("name", "schema_version", "total_documents", "total_chunks", "total_code_snippets")


@query(
    "import_bundle",
    f"""
    WITH {_CHUNKS_SQL} SELECT 'copy' AS name, (SELECT count(*) FROM docs WHERE context_id = 'src0') AS documents,
      (SELECT count(*) FROM ch WHERE context_id = 'src0') AS chunks, (SELECT CAST(sum(tokens) AS BIGINT) FROM ch
      WHERE context_id = 'src0') AS tokens, (SELECT count(*) FROM ch WHERE context_id = 'src0') AS code_snippets
    """,
)
def _import_bundle(spark, sf):
    corpus = filled_corpus(spark, sf)
    path, copy = shared_dir(spark, "bundle"), f"copy-{uuid.uuid4().hex}"
    bundle.export_context(corpus, "src0", path, "parquet", _NOW)
    bundle.import_context(corpus, path, form="parquet", name=copy, now=_NOW)
    mine = corpus.statistics().where(F.col("name") == copy)
    return mine.drop("context_id").withColumn("name", F.lit("copy"))


@query(
    "merge_contexts",
    f"""
    WITH {_CHUNKS_SQL} SELECT 'both' AS target, CAST(2 AS INT) AS source_contexts, count(*) AS documents_merged,
      (SELECT count(*) FROM ch WHERE context_id IN ('src0', 'src5')) AS chunks_merged,
      (SELECT count(*) FROM ch WHERE context_id IN ('src0', 'src5')) AS code_snippets_merged
    FROM docs WHERE context_id IN ('src0', 'src5')
    """,
)
def _merge_contexts(spark, sf):
    corpus = filled_corpus(spark, sf)
    merged = merge_contexts(corpus, ["src0", "src5"], f"both-{uuid.uuid4().hex}", now=_NOW)
    return merged.drop("mode").withColumn("target", F.lit("both"))


def _stored_corpus(spark, sf) -> tuple[Corpus, str]:
    """All documents and their pieces stored in one context; ids are those of the tables."""
    corpus = Corpus(spark, shared_dir(spark, "corpus"), buckets=4)
    corpus.register(spark.createDataFrame([("all",)], "name string"), _NOW)
    owner = corpus.context_id("all")
    documents = corpus_documents(spark, sf).select(
        F.lit(owner).alias("context_id"), "doc_id", F.concat(F.lit("doc://"), "doc_id").alias("url"), "title", "content", "indexed_at", F.lit("file").alias("source_type")
    )
    # As an ingest names them: by context and URL.
    documents = documents.withColumn("doc_id", schema.document_id("context_id", "url"))
    corpus.append("documents", documents)
    pieces = chunk_frame(spark, sf).withColumn("context_id", F.lit(owner))
    corpus.append("chunks", pieces.withColumn("doc_id", schema.document_id("context_id", F.concat(F.lit("doc://"), "doc_id"))))
    return corpus, owner


@query(
    "stored_upsert",
    """
    SELECT 'doc://' || doc_id AS url, CASE WHEN lang = 'fr' THEN 'New ' || doc_id ELSE 'Doc ' || doc_id END AS title,
      'file' AS source_type, CAST(length(text) + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS INT) AS chars FROM documents
    UNION ALL
    SELECT 'more://' || doc_id, 'More ' || doc_id, 'url', CAST(length(text) AS INT) FROM documents WHERE lang = 'es'
    """,
)
def _stored_upsert(spark, sf):
    """French documents come again with another title and text, Spanish ones under another URL; the tables are read again."""
    corpus, owner = _stored_corpus(spark, sf)
    docs = corpus_documents(spark, sf)
    again = docs.where("lang = 'fr'").select(
        F.concat(F.lit("doc://"), "doc_id").alias("url"), F.concat(F.lit("New "), "doc_id").alias("title"), F.concat("content", F.lit("+")).alias("content"), "indexed_at"
    )
    more = docs.where("lang = 'es'").select(
        F.concat(F.lit("more://"), "doc_id").alias("url"), F.concat(F.lit("More "), "doc_id").alias("title"), "content", "indexed_at"
    )
    corpus.upsert_documents(again.unionByName(more).withColumns({"context_id": F.lit(owner), "source_type": F.lit("url")}))
    return corpus.read("documents", owner).select("url", "title", "source_type", F.length("content").alias("chars"))


@query(
    "stored_delete",
    f"""
    WITH {_CHUNKS_SQL}, left_over AS (SELECT doc_id FROM documents WHERE lang <> 'de')
    SELECT 'documents' AS kind, count(*) AS n FROM left_over UNION ALL
    SELECT 'chunks', count(*) FROM ch JOIN left_over USING (doc_id) UNION ALL
    SELECT 'deleted', count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'after the context', 0
    """,
)
def _stored_delete(spark, sf):
    """German documents are deleted with their chunks, then the whole context; counts of the tables in between."""
    corpus, owner = _stored_corpus(spark, sf)
    gone = corpus_documents(spark, sf).where("lang = 'de'").select(schema.document_id(F.lit(owner), F.concat(F.lit("doc://"), "doc_id")).alias("doc_id"))
    deleted = corpus.delete_documents("all", gone)
    counts = [(t, corpus.read(t, owner).count()) for t in ("documents", "chunks")]
    corpus.delete_context("all")
    after = corpus.read("documents").count() + corpus.read("chunks").count() + corpus.read("contexts").count()
    rows = [*counts, ("deleted", deleted), ("after the context", after)]
    return spark.createDataFrame(rows, "kind string, n long")


@query(
    "stored_merge",
    f"""
    WITH {DOCS_SQL}, d AS (SELECT *, 'doc://' || title AS own_url FROM docs WHERE context_id IN ('src0', 'src5'))
    SELECT title, CAST(length(content) AS INT) AS chars, CAST((length(content) + 999) // 1000 AS INT) AS chunks FROM d
    """,
)
def _stored_merge(spark, sf):
    """Two contexts merged into a third, which is read again: titles, text lengths and chunks of every document."""
    corpus = filled_corpus(spark, sf)
    target = f"merged-{uuid.uuid4().hex}"
    merge_contexts(corpus, ["src0", "src5"], target, now=_NOW)
    merge_contexts(corpus, ["src0", "src5"], target, now=_NOW)  # a second merge adds nothing
    cid = corpus.context_id(target)
    chunks = corpus.read("chunks", cid).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    documents = corpus.read("documents", cid).select("doc_id", "title", F.length("content").alias("chars"))
    return documents.join(chunks, "doc_id", "left").select("title", "chars", F.coalesce("chunks", F.lit(0)).alias("chunks"))


_STORED_SQL = f"""
WITH {_SNIPPETS_SQL}, n AS (SELECT doc_id, count(*) AS snippets FROM snips GROUP BY doc_id)
SELECT 'http://docs/' || doc_id AS url, 'processed' AS status, CAST(snippets AS INT) AS snippets FROM n
"""


@query("store_processed", _STORED_SQL)
def _store_processed(spark, sf):
    # Snippet offsets are those of the raw text, so the number of snippets follows from the text alone.
    corpus = Corpus(spark, shared_dir(spark, "corpus"), buckets=2)
    corpus.register(spark.createDataFrame([("all",)], "name string"), _NOW)
    pages = markdown_documents(spark, sf).select(
        F.concat(F.lit("http://docs/"), "doc_id").alias("url"), F.concat(F.lit("Doc "), "doc_id").alias("title"), "content"
    )
    out = store_processed(
        corpus, "all", pages, embedder=HashEmbedder(64), snippet_embedder=HashEmbedder(64), now=_NOW
    )
    return out.select("url", "status", "snippets")


# Streams --------------------------------------------------------------------------------------------------------------


@query("ingest_stream")
def _ingest_stream(spark, sf):
    corpus = Corpus(spark, shared_dir(spark, "corpus"), buckets=2)
    corpus.register(spark.createDataFrame([("pages",)], "name string"), _NOW)
    pages = page_stream(spark, sf, names="pages.parquet")
    stream = ingest_stream(corpus, "pages", pages, embedder=HashEmbedder(64), snippet_embedder=HashEmbedder(64), now=_NOW)
    stream.awaitTermination()
    return corpus.read("documents").select("doc_id", "url", "title", "chunk_count")


@query("ledger_stream", f"WITH {_EVENTS_SQL} SELECT job_id, status, round(progress, 6) AS progress, error_message, {_STAMPS} FROM st")
def _ledger_stream(spark, sf):
    batch = job_events(spark, sf)
    source, target = shared_dir(spark, "events"), shared_dir(spark, "ledger")
    # Several files and micro-batches; every event is delivered twice in a row.
    twice = batch.repartitionByRange(4, "ts").select(F.explode(F.array_repeat(F.struct("*"), 2)).alias("e")).select("e.*")
    twice.write.parquet(source)
    events = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(source)
    ledger_stream(spark, events, target).awaitTermination()
    state = read_state(spark, target)
    return state.select(
        "job_id", "status", F.round("progress", 6).alias("progress"), "error_message", _stamp("started_at"), _stamp("updated_at"), _stamp("completed_at")
    )

