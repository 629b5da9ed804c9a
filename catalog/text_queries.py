"""URL, page, cleaning, snippet, chunk and preparation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.registry import (
    MARKDOWN_SQL,
    markdown_documents,
    pattern_literal,
    query,
    sql_blank,
    sql_lines,
    sql_matches,
    sql_replace,
    sql_strip,
    table,
    text_literal,
    texts,
)
from doclake.functions import chunks as K
from doclake.functions import cleaning as C
from doclake.functions import code as X
from doclake.functions import text as T
from doclake.functions import urls as U
from doclake.functions.patterns import BLANK
from doclake.functions.summaries import LeadSummarizer, summary_only, title_and_summary
from doclake.functions.vectors import code_embedder, embed, text_embedder
from doclake.operators.chunking import chunk_documents, doc_stats, renumber
from doclake.operators.quality import crawl_summary, filter_quality, score_pages
from doclake.operators.snippets import cleaned_content, extract_snippets, link_snippets, snippets_of
from doclake.sources.pages import pages_to_markdown

# URLs -----------------------------------------------------------------------------------------------------------------


@query(
    "normalize_scheme",
    """
    SELECT page_id, url AS with_scheme, 'https://' || regexp_replace(url, '^https?://', '') AS without_scheme FROM pages
    """,
)
def _normalize_scheme(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select(
        "page_id",
        U.normalize_scheme("url").alias("with_scheme"),
        U.normalize_scheme(bare).alias("without_scheme"),
    )


@query("base_url", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site FROM pages")
def _base_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.base_url("url").alias("site"))


@query("url_key", "SELECT page_id, rtrim(url || '//', '/') AS url_key FROM pages")
def _url_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_key(F.concat("url", F.lit("//"))).alias("url_key"))


_URL_TITLE_SQL = """
    WITH p AS (
      SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages
    ), s AS (
      SELECT page_id, url, replace(replace(string_split(trim(path, '/'), '/')[-1], '-', ' '), '_', ' ') AS seg FROM p
    )
    SELECT page_id, CASE WHEN seg = '' THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ELSE
      list_aggregate(list_transform(regexp_extract_all(seg, '[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'),
        lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') END AS title
    FROM s
    """


@query("url_title", _URL_TITLE_SQL)
def _url_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_title("url").alias("title"))


@query(
    "valid_url",
    """
    SELECT page_id, CAST(regexp_matches(url, '^[a-z]+://[^/?#]+') AS INT) AS url_ok,
           CAST(regexp_matches(regexp_replace(url, '^https?:', ''), '^[a-zA-Z]+://[^/?#]+') AS INT) AS bare_ok
    FROM pages
    """,
)
def _valid_url(spark, sf):
    bare = F.regexp_replace("url", "^https?:", "")
    return table(spark, sf, "pages").select(
        "page_id", U.is_url("url").cast("int").alias("url_ok"), U.is_url(bare).cast("int").alias("bare_ok")
    )


# Pages ----------------------------------------------------------------------------------------------------------------


@query("pages_markdown")
def _pages_markdown(spark, sf):
    return pages_to_markdown(texts(spark, sf, "pages", "page_id", "url", "html"))


# As in HTML, the semicolon of these four references may be missing; a page without a title gets one from its URL.
@query(
    "page_titles",
    f"""
    WITH t AS (SELECT page_id, array_to_string(list_filter(string_split_regex(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS title
      FROM pages), u AS ({_URL_TITLE_SQL})
    SELECT page_id, coalesce(nullif(t.title, ''), u.title) AS title FROM t JOIN u USING (page_id)
    """,
)
def _page_titles(spark, sf):
    return pages_to_markdown(texts(spark, sf, "pages", "page_id", "url", "html")).select("page_id", "title")


@query("quality_filter", f"SELECT doc_id, n_chars FROM documents WHERE length({sql_strip('text')}) >= 75")
def _quality_filter(spark, sf):
    return filter_quality(table(spark, sf, "documents"), text="text").select("doc_id", "n_chars")


_KEYWORDS = ["the", "tion", "ment", "Und", "que"]
_HITS = " + ".join(f"CAST(contains(lower({{0}}), '{k.lower()}') AS INT)" for k in _KEYWORDS)


@query("relevance", f"SELECT doc_id, round(least(({_HITS.format('text')}) / 5.0, 1.0), 6) AS relevance FROM documents")
def _relevance(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(T.relevance("text", _KEYWORDS), 6).alias("relevance"))


@query(
    "auto_keywords",
    """
    SELECT page_id, CASE WHEN regexp_matches(lower(url), 'docs|guide|tutorial|api')
      THEN 'docs,guide,tutorial,api,reference' ELSE 'none' END AS keywords FROM pages
    """,
)
def _auto_keywords(spark, sf):
    keywords = F.coalesce(F.array_join(T.auto_keywords("url"), ","), F.lit("none"))
    return table(spark, sf, "pages").select("page_id", keywords.alias("keywords"))


@query(
    "crawl_summary",
    f"""
    WITH kept AS (
      SELECT source, length(text) AS n, least(({_HITS.format('text')}) / 5.0, 1.0) AS r FROM documents
      WHERE length({sql_strip('text')}) >= 75
    ), found AS (SELECT source, count(*) AS pages_found FROM documents GROUP BY source)
    SELECT f.source, pages_found, count(n) AS pages_extracted, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_content_length,
      CAST(coalesce(sum(n) // count(n), 0) AS BIGINT) AS average_page_size,
      round(coalesce(avg(r), 1.0), 6) AS average_relevance_score
    FROM found f LEFT JOIN kept k ON f.source = k.source GROUP BY f.source, pages_found
    """,
)
def _crawl_summary(spark, sf):
    found = table(spark, sf, "documents")
    kept = filter_quality(found, text="text").select(
        "source", F.length("text").alias("length"), T.relevance("text", _KEYWORDS).alias("relevance_score")
    )
    out = crawl_summary(found, kept, scored=True, keys=("source",))
    return out.withColumn("average_relevance_score", F.round("average_relevance_score", 6))


@query("scored_pages")
def _scored_pages(spark, sf):
    pages = pages_to_markdown(texts(spark, sf, "pages", "page_id", "url", "html"))
    return score_pages(filter_quality(pages), ["docs", "the", "que"]).drop("markdown", "error")


# Cleaning -------------------------------------------------------------------------------------------------------------


def _digest(expr: str) -> str:
    return f"md5({expr}) AS digest, CAST(length({expr}) AS INT) AS chars"


def _cleaning(name: str, oracle_expr: str, step) -> None:
    sql = f"WITH {MARKDOWN_SQL}, c AS (SELECT doc_id, {oracle_expr} AS out FROM md) SELECT doc_id, {_digest('out')} FROM c"

    @query(name, sql)
    def run(spark, sf):
        out = markdown_documents(spark, sf).select("doc_id", step("content").alias("out"))
        return out.select("doc_id", F.md5("out").alias("digest"), F.length("out").alias("chars"))


def _sql_noise(expr: str) -> str:
    return reduce(lambda t, p: sql_replace(t, p, "", "im"), C.NAVIGATION_PATTERNS + C.NOISE_PATTERNS, expr)


def _sql_noise_line(x: str) -> str:
    phrases = " OR ".join(f"contains(lower({x}), '{p}')" for p in C.NOISE_PHRASES)
    bare = sql_strip(x)
    return (
        f"({phrases} OR {sql_matches(x, C.RULE_LINE)} OR (length({bare}) < 3 AND {sql_matches(bare, C.SHORT_LINE)}))"
    )


def _sql_line(x: str) -> str:
    return sql_replace(reduce(lambda t, r: sql_replace(t, *r), C.LINE_RULES, x), r"\s+\z", "")


def _sql_map_lines(expr: str, body: str) -> str:
    kept = f"list_filter(list_transform({sql_lines(expr)}, lambda x: {body}), lambda y: y IS NOT NULL)"
    return f"array_to_string({kept}, chr(10))"


def _sql_collapse(expr: str) -> str:
    t = f"regexp_replace({expr}, '\\A\\n+', '')"
    t = f"regexp_replace({t}, '\\n{{2,}}\\z', chr(10))"
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _sql_artifacts(expr: str) -> str:
    return reduce(lambda t, p: sql_replace(t, p, ""), C.ARTIFACT_PATTERNS, expr)


def _sql_whitespace(expr: str) -> str:
    t = sql_replace(expr, r"\n\s*\n\s*\n+", "\n\n")
    t = f"regexp_replace({t}, '(?m)[{BLANK}]+$', '', 'g')"
    t = sql_replace(t, r"\n(#+\s+.*?)\n", "\n\n$1\n\n")
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


_LINES_BODY = (
    f"CASE WHEN {sql_blank('x')} THEN '' WHEN NOT {_sql_noise_line('x')} THEN nullif({_sql_line('x')}, '') END"
)
_cleaning("strip_noise", _sql_noise("content"), C.strip_noise)
_cleaning(
    "drop_noise_lines",
    _sql_map_lines("content", f"CASE WHEN {sql_blank('x')} OR NOT {_sql_noise_line('x')} THEN x END"),
    C.drop_noise_lines,
)
_cleaning(
    "collapse_blanks",
    _sql_collapse(_sql_map_lines("content", f"CASE WHEN {sql_blank('x')} THEN '' ELSE x END")),
    C.collapse_blanks,
)
_cleaning(
    "normalize_lines",
    _sql_map_lines("content", f"CASE WHEN {sql_blank('x')} THEN '' ELSE nullif({_sql_line('x')}, '') END"),
    C.normalize_lines,
)
_cleaning("strip_artifacts", _sql_artifacts("content"), C.strip_artifacts)
_cleaning("normalize_whitespace", _sql_whitespace("content"), C.normalize_whitespace)
_cleaning(
    "clean_markdown",
    sql_strip(_sql_whitespace(_sql_artifacts(_sql_collapse(_sql_map_lines(_sql_noise("content"), _LINES_BODY))))),
    C.clean_markdown,
)

# Snippets -------------------------------------------------------------------------------------------------------------


def _sql_is_code(x: str) -> str:
    found = " OR ".join(f"contains({x}, {text_literal(i)})" for i in X.CODE_INDICATORS)
    return f"(length({sql_strip(x)}) >= 10 AND ({found}))"


def _sql_preview(x: str) -> str:
    s = sql_strip("y")
    lines = sql_lines(x)
    good = f"list_filter({lines}, lambda y: {s} <> '' AND NOT starts_with({s}, '#') AND NOT starts_with({s}, '//'))[1:4]"
    first = f"list_filter({lines}[1:4], lambda y: {s} <> '')"
    chosen = f"(CASE WHEN len({good}) < 2 THEN {first} ELSE {good} END)"
    joined = f"coalesce(array_to_string(list_transform({chosen}, lambda y: {sql_replace('y', r'\s+\z', '')}), ' '), '')"
    return f"replace(CASE WHEN length({joined}) > 200 THEN {joined}[1:197] || '...' ELSE {joined} END, '\"', '\\\"')"


@query("code_validity", f"SELECT doc_id, CAST({_sql_is_code('text')} AS INT) AS is_code FROM documents")
def _code_validity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_code("text").cast("int").alias("is_code"))


@query("code_preview", f"SELECT doc_id, {_sql_preview('text')} AS preview FROM documents")
def _code_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview("text").alias("preview"))


@query(
    "language_guess",
    """
    SELECT conv_id, turn, CASE WHEN contains(t, 'import ') AND (contains(t, 'def ') OR contains(t, 'class ')) THEN 'python'
      WHEN contains(t, 'function ') OR contains(t, 'const ') OR contains(t, 'let ') THEN 'javascript'
      WHEN contains(t, '#!/bin/bash') OR contains(t, '#!/bin/sh') THEN 'bash' ELSE 'text' END AS language
    FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'import x' || chr(10) || 'class ' ELSE 'let ' END
      || text AS t FROM conversations UNION ALL SELECT conv_id, turn + 100000, text FROM conversations)
    """,
)
def _language_guess(spark, sf):
    c = table(spark, sf, "conversations")
    head = F.when(F.col("role") == "user", "import x\nclass ").otherwise("let ")
    both = c.select("conv_id", "turn", F.concat(head, "text").alias("text")).unionByName(
        c.select("conv_id", (F.col("turn") + 100000).alias("turn"), "text")
    )
    return both.select("conv_id", "turn", X.guess_language("text").alias("language"))


@query(
    "line_stats",
    f"""
    SELECT doc_id, len({sql_lines('text')}) AS lines, len(list_filter({sql_lines('text')}, lambda x: NOT {sql_blank('x')}))
      AS filled_lines, length(text) AS chars FROM documents
    """,
)
def _line_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.line_stats("text").alias("s")).select("doc_id", "s.*")


_FENCES = f"regexp_extract_all(content, {pattern_literal(X.FENCE, 's')}"
_INLINES = f"regexp_extract_all(content, {pattern_literal(X.INLINE)}"
_SNIPPETS_SQL = f"""
{MARKDOWN_SQL}, raw AS (
  SELECT doc_id, context_id, content AS doc, 'code_block' AS snippet_type, unnest({_FENCES}, 0)) AS original,
    unnest({_FENCES}, 2)) AS inner_text FROM md
  UNION ALL
  SELECT doc_id, context_id, content, 'inline_code', unnest({_INLINES}, 0)), unnest({_INLINES}, 1)) FROM md
), cut AS (
  SELECT doc_id, context_id, snippet_type, original, {sql_strip('inner_text')} AS content,
    instr(doc, original) - 1 AS start_pos, instr(doc, original) - 1 + length(original) AS end_pos FROM raw
), snips AS (
  SELECT *, sha256(concat_ws(chr(1), CAST(doc_id AS VARCHAR), CAST(start_pos AS VARCHAR), snippet_type)) AS snippet_id,
    len({sql_lines('content')}) AS line_count, length(content) AS char_count, {_sql_preview('content')} AS preview
  FROM cut WHERE {_sql_is_code('content')} AND (snippet_type = 'code_block' OR length(content) > 20)
)
"""


@query(
    "snippets",
    f"""WITH {_SNIPPETS_SQL} SELECT doc_id, snippet_id, content, snippet_type, start_pos, end_pos, line_count, char_count,
    preview FROM snips""",
)
def _snippets(spark, sf):
    return extract_snippets(markdown_documents(spark, sf)).drop("ordinal", "original")


_MARK = "'[CODE_SNIPPET: size=' || char_count || '_chars, preview=\"' || preview || '\", snippet_id=' || snippet_id || ']'"


@query(
    "cleaned_content",
    f"""
    WITH {_SNIPPETS_SQL}, ranked AS (
      SELECT doc_id, original, {_MARK} AS mark, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) AS n FROM snips
    ), wide AS (
      SELECT doc_id, max(original) FILTER (n = 1) AS o1, max(mark) FILTER (n = 1) AS m1, max(original) FILTER (n = 2) AS o2,
        max(mark) FILTER (n = 2) AS m2, max(original) FILTER (n = 3) AS o3, max(mark) FILTER (n = 3) AS m3
      FROM ranked GROUP BY doc_id
    )
    SELECT doc_id, md5(t) AS digest, length(t) AS chars
    FROM (SELECT doc_id, replace(replace(replace(content, o1, m1), o2, m2), o3, m3) AS t FROM md JOIN wide USING (doc_id))
    """,
)
def _cleaned_content(spark, sf):
    out = cleaned_content(markdown_documents(spark, sf))
    return out.select("doc_id", F.md5("cleaned_content").alias("digest"), F.length("cleaned_content").alias("chars"))


@query(
    "placeholder_ids",
    f"""
    WITH {_SNIPPETS_SQL} SELECT doc_id, string_agg(snippet_id, ',' ORDER BY start_pos) AS ids FROM snips GROUP BY doc_id
    """,
)
def _placeholder_ids(spark, sf):
    out = cleaned_content(markdown_documents(spark, sf))
    return out.select("doc_id", F.array_join(X.placeholder_ids("cleaned_content"), ",").alias("ids"))


@query(
    "snippets_of_document",
    f"""WITH {_SNIPPETS_SQL} SELECT doc_id, snippet_id, start_pos, content FROM snips WHERE doc_id = 7""",
)
def _snippets_of_document(spark, sf):
    found = extract_snippets(markdown_documents(spark, sf))
    return snippets_of(found, 7).select("doc_id", "snippet_id", "start_pos", "content")


_SPANS_SQL = """
  c AS (SELECT doc_id, doc_id || '-' || i AS chunk_id, i * 500 AS char_start, least(i * 500 + 600, n_chars) AS char_end
        FROM documents, unnest(range(0, (n_chars + 499) // 500)) AS u(i)),
  s AS (SELECT doc_id, doc_id || '/' || i AS snippet_id, i * 300 AS start_pos, i * 300 + 40 AS end_pos
        FROM documents, unnest(range(0, (n_chars + 299) // 300)) AS u(i))
"""


def _fixed_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")

    def spread(step: int):
        last = F.floor((F.col("n_chars") + step - 1) / step) - 1
        return d.where(F.col("n_chars") > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    chunks = spread(500).select(
        "doc_id",
        F.concat_ws("-", "doc_id", "i").alias("chunk_id"),
        (F.col("i") * 500).alias("char_start"),
        F.least(F.col("i") * 500 + 600, F.col("n_chars")).alias("char_end"),
    )
    snippets = spread(300).select(
        "doc_id",
        F.concat_ws("/", "doc_id", "i").alias("snippet_id"),
        (F.col("i") * 300).alias("start_pos"),
        (F.col("i") * 300 + 40).alias("end_pos"),
    )
    return chunks, snippets


@query(
    "overlap_link",
    f"""
    WITH {_SPANS_SQL}
    SELECT c.chunk_id, coalesce(string_agg(s.snippet_id, ',' ORDER BY s.start_pos), '') AS snippet_ids FROM c
    LEFT JOIN s ON c.doc_id = s.doc_id AND c.char_start <= s.end_pos AND c.char_end >= s.start_pos GROUP BY c.chunk_id
    """,
)
def _overlap_link(spark, sf):
    linked = link_snippets(*_fixed_spans(spark, sf))
    return linked.select("chunk_id", F.array_join("code_snippet_ids", ",").alias("snippet_ids"))


# Chunks ---------------------------------------------------------------------------------------------------------------


@query("chunks")
def _chunks(spark, sf):
    d = texts(spark, sf, "documents", "doc_id", "source", "text").withColumnRenamed("text", "content")
    return chunk_documents(d, keys=("doc_id", "source"))


@query(
    "chunk_cover",
    f"""
    WITH d AS (SELECT doc_id, text, {sql_strip('text')} AS body FROM documents)
    SELECT doc_id, CAST(instr(text, body) - 1 AS INT) AS char_start,
      CAST(instr(text, body) - 1 + length(body) AS INT) AS char_end, CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS moved,
      CAST(CASE WHEN length(text) <= 4000 THEN 1 ELSE 0 END AS BIGINT) AS only_chunk FROM d WHERE body <> ''
    """,
)
def _chunk_cover(spark, sf):
    """Chunks reach from the first to the last character, none is too long, each is the text at its offsets."""
    d = texts(spark, sf, "documents", "doc_id", "text").withColumnRenamed("text", "content")
    chunks = chunk_documents(d)
    whole = d.select("doc_id", F.col("content").alias("whole"))
    there = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return (
        chunks.join(whole, "doc_id")
        .groupBy("doc_id")
        .agg(
            F.min("char_start").alias("char_start"),
            F.max("char_end").alias("char_end"),
            F.count_if(F.length("content") > 4000).alias("oversize"),
            F.count_if(F.col("content") != there).alias("moved"),
            F.when(F.max(F.length("whole")) <= 4000, F.count("*")).otherwise(0).alias("only_chunk"),
        )
    )


@query("chunks_small")
def _chunks_small(spark, sf):
    d = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return chunk_documents(d, size=1000, overlap=200, keys=("conv_id", "turn"))


@query("chunks_markdown")
def _chunks_markdown(spark, sf):
    return chunk_documents(cleaned_content(markdown_documents(spark, sf)).drop("content"), text="cleaned_content")


@query(
    "first_span",
    """
    WITH p AS (SELECT doc_id, i, text, substr(text, i * 500 + 1, 500) AS piece
               FROM documents, unnest(range(0, (n_chars + 499) // 500)) AS u(i))
    SELECT doc_id, i, instr(text, piece) - 1 AS char_start, instr(text, piece) - 1 + length(piece) AS char_end FROM p
    """,
)
def _first_span(spark, sf):
    d = table(spark, sf, "documents").where(F.col("n_chars") > 0)
    last = F.floor((F.col("n_chars") + 499) / 500) - 1
    parts = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    piece = F.substring("text", (F.col("i") * 500 + 1).cast("int"), F.lit(500))
    return parts.select("doc_id", "i", K.first_span("text", piece).alias("s")).select("doc_id", "i", "s.*")


@query(
    "line_span",
    """
    WITH p AS (SELECT doc_id, i, text, i * 500 AS lo, least(i * 500 + 600, n_chars) AS hi
               FROM documents, unnest(range(0, (n_chars + 499) // 500)) AS u(i))
    SELECT doc_id, i, len(string_split(substr(text, 1, lo), chr(10))) AS start_line,
      len(string_split(substr(text, 1, greatest(hi - 1, lo)), chr(10))) AS end_line FROM p
    """,
)
def _line_span(spark, sf):
    d = table(spark, sf, "documents").where(F.col("n_chars") > 0)
    last = F.floor((F.col("n_chars") + 499) / 500) - 1
    parts = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    lo = (F.col("i") * 500).cast("int")
    hi = F.least(F.col("i") * 500 + 600, F.col("n_chars")).cast("int")
    return parts.select("doc_id", "i", K.line_span("text", lo, hi).alias("s")).select("doc_id", "i", "s.*")


@query("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INT) AS tokens FROM documents")
def _token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.token_estimate("text").alias("tokens"))


@query(
    "optimal_chunk_size",
    """
    SELECT doc_id, CAST(CASE WHEN n_chars < 2000 THEN 500 WHEN n_chars < 10000 THEN 1000 WHEN n_chars < 50000 THEN 1500
      ELSE 2000 END AS INT) AS chunk_size, CAST(CASE WHEN n_chars // 5 < 500 THEN 500 WHEN n_chars // 5 > 2000 THEN 2000
      ELSE n_chars // 5 // 100 * 100 END AS INT) AS for_five FROM documents
    """,
)
def _optimal_chunk_size(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        K.optimal_chunk_size("n_chars").alias("chunk_size"),
        K.optimal_chunk_size("n_chars", 5).alias("for_five"),
    )


@query(
    "renumber_chunks",
    """
    SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS chunk_index
    FROM embeddings WHERE embedding[1] > 0
    """,
)
def _renumber_chunks(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "label",
        "vec_id",
        F.col("vec_id").alias("chunk_index"),
        F.when(F.get("embedding", F.lit(0)) > 0, F.col("embedding")).alias("embedding"),
    )
    return renumber(e, keys=("label",)).select("label", "vec_id", "chunk_index")


@query(
    "doc_stats",
    f"""
    WITH {_SPANS_SQL}, nc AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
      ns AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
    SELECT d.doc_id, length(text) AS original_length, coalesce(nc.n, 0) AS total_chunks,
      coalesce(ns.n, 0) AS total_code_snippets FROM documents d LEFT JOIN nc USING (doc_id) LEFT JOIN ns USING (doc_id)
    """,
)
def _doc_stats(spark, sf):
    return doc_stats(table(spark, sf, "documents"), *_fixed_spans(spark, sf), text="text")


# Preparation and enrichment -------------------------------------------------------------------------------------------


def _sql_prepare(x: str, n: int) -> str:
    return f"substr({sql_strip(sql_replace(x, r'\s+', ' '))}, 1, {n})"


@query(
    "prepare_text",
    f"SELECT doc_id, md5({_sql_prepare('text', 30000)}) AS digest, {_sql_prepare('text', 40)} AS head FROM documents",
)
def _prepare_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.prepare_text("text")).alias("digest"), T.prepare_text("text", 40).alias("head")
    )


@query("embed_text")
def _embed_text(spark, sf):
    d = texts(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", embed("text", text_embedder()).alias("embedding"))


@query("embed_code")
def _embed_code(spark, sf):
    found = extract_snippets(markdown_documents(spark, sf))
    return found.select("snippet_id", embed("content", code_embedder()).alias("embedding"))


_PLAIN = sql_strip(sql_replace("text", r"\s+", " "))
_LEAD = (
    f"array_to_string(list_transform(regexp_extract_all({_PLAIN}, '[^.!?]+(?:[.!?]+|$)')[1:3], "
    f"lambda x: {sql_strip('x')}), ' ')"
)


@query(
    "title_and_summary",
    f"""
    WITH r AS (SELECT doc_id, length({sql_strip('text')}) >= 50 AS wanted,
      {sql_strip(f"array_to_string(string_split({_PLAIN}, ' ')[1:8], ' ')")} AS t, {sql_strip(f"coalesce({_LEAD}, '')")} AS s
      FROM documents)
    SELECT doc_id, CASE WHEN wanted AND length(t) >= 5 THEN t END AS title,
      CASE WHEN wanted AND length(s) >= 20 THEN s END AS summary,
      CASE WHEN wanted AND length(s) >= 20 THEN 'lead-sentences' END AS summary_model FROM r
    """,
)
def _title_and_summary(spark, sf):
    d = texts(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", title_and_summary("text", LeadSummarizer()).alias("t")).select("doc_id", "t.*")


@query(
    "summary_only",
    f"""
    WITH d AS (SELECT doc_id, length(text) > 600 AND NOT {sql_blank('text')} AS wanted, text FROM documents),
      r AS (SELECT doc_id, wanted, {sql_strip(f"coalesce({_LEAD}, '')")} AS s FROM d)
    SELECT doc_id, CASE WHEN wanted AND length(s) >= 20 THEN s END AS summary FROM r
    """,
)
def _summary_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", summary_only("text", LeadSummarizer()).alias("summary"))


@query(
    "reply_parse",
    f"""
    WITH r AS (
      SELECT doc_id, list_filter({sql_lines("trim(reply)")}, lambda x: starts_with(x, 'Title:')) AS t,
        list_filter({sql_lines("trim(reply)")}, lambda x: starts_with(x, 'Summary:')) AS s
      FROM (SELECT doc_id, 'Title: draft' || chr(10) || 'Title: ' || substr(text, 1, CAST(doc_id % 9 AS INT)) || chr(10)
        || 'Summary: ' || replace(substr(text, 1, 60), chr(10), ' ') AS reply FROM documents)
    ), v AS (SELECT doc_id, {sql_strip("t[-1][7:]")} AS t, {sql_strip("s[-1][9:]")} AS s FROM r)
    SELECT doc_id, CASE WHEN length(t) >= 5 THEN t END AS title, CASE WHEN length(s) >= 20 THEN s END AS summary FROM v
    """,
)
def _reply_parse(spark, sf):
    head = F.substring("text", F.lit(1), (F.col("doc_id") % 9).cast("int"))
    reply = F.concat(
        F.lit("Title: draft\nTitle: "),
        head,
        F.lit("\nSummary: "),
        F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")),
    )
    parsed = table(spark, sf, "documents").select("doc_id", T.parse_title_summary(reply).alias("p"))
    return parsed.select("doc_id", "p.*")


@query(
    "highlight",
    "SELECT doc_id, regexp_replace(text, '(?i)(the|tion)', '**\\1**', 'g') AS marked FROM documents",
)
def _highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.highlight("text", "The of tion").alias("marked"))
