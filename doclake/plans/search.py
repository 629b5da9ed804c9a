"""Search over a stored context: mode dispatch and result shape."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclake import schema
from doclake.functions.vectors import Embedder, code_embedder, text_embedder
from doclake.operators import shaping
from doclake.operators.documents import attach_snippets
from doclake.operators.fulltext import fulltext_hits, fulltext_search, fulltext_search_code
from doclake.operators.hybrid import hybrid_search, hybrid_search_code, merge_hits
from doclake.operators.vector_search import SEARCH_MIN_SIMILARITY, vector_search, vector_search_batch, vector_search_code
from doclake.plans import indexes
from doclake.sources.corpus import Corpus


def _check(query: str, mode: str, limit: int) -> None:
    schema.check_choice(mode, schema.SEARCH_MODES, "mode")
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if limit < 1:
        raise ValueError("limit must be at least 1")


def search_frames(
    chunks: DataFrame,
    documents: DataFrame,
    query: str,
    mode: str = "hybrid",
    limit: int = 10,
    embedder: Embedder | None = None,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    **options,
) -> DataFrame:
    """Search chunks by vector, text or both; every mode returns chunk rows with document fields and ``score``."""
    _check(query, mode, limit)
    if mode == "fulltext":
        return fulltext_search(chunks, documents, query, limit, **options)
    vector = (embedder or text_embedder()).query(query)
    if mode == "vector":
        return vector_search(chunks, documents, vector, limit, min_similarity)
    return hybrid_search(chunks, documents, query, vector, limit, min_similarity=min_similarity, **options)


def search_code_frames(
    snippets: DataFrame,
    documents: DataFrame,
    query: str,
    mode: str = "hybrid",
    limit: int = 10,
    embedder: Embedder | None = None,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    **options,
) -> DataFrame:
    """Search snippets by vector, text or both."""
    _check(query, mode, limit)
    if mode == "fulltext":
        return fulltext_search_code(snippets, documents, query, limit, **options)
    vector = (embedder or code_embedder()).query(query)
    if mode == "vector":
        return vector_search_code(snippets, documents, vector, limit, min_similarity)
    return hybrid_search_code(snippets, documents, query, vector, limit, min_similarity=min_similarity, **options)


def _by_index(
    corpus: Corpus,
    context: str,
    query: str,
    mode: str,
    limit: int,
    embedder: Embedder | None = None,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    stemming: bool = False,
    **options,
) -> DataFrame | None:
    """The result of ``search_frames`` through the context's indexes; None where they do not serve the search."""
    _check(query, mode, limit)
    if options:
        return None
    wanted = 2 * limit if mode == "hybrid" else limit
    text = indexes.text_hits(corpus, context, query, wanted, stemming) if mode != "vector" else None
    if mode == "fulltext":
        return None if text is None else indexes.with_fields(corpus, context, text, limit)
    near = indexes.vector_hits(corpus, context, embedder.query(query), wanted, min_similarity)
    if near is None:
        return None
    if mode == "vector":
        return indexes.with_fields(corpus, context, near[0], limit)
    if text is None:
        text = fulltext_hits(corpus.read("chunks", context), query, wanted, stemming=stemming)
    return indexes.with_fields(corpus, context, merge_hits(near[0], text, limit), limit)


def search_batch(
    corpus: Corpus,
    name: str,
    queries: DataFrame,
    limit: int = 10,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    table: str = "chunks",
) -> DataFrame:
    """The best chunks or snippets of a context for each of many vectors (query_id, embedding): query_id, id, score, rank.

    With an index of the context's present state queries go to the cells their bounds admit; otherwise blocks of queries meet
    blocks of vectors. The results are the same.
    """
    context, id_col = corpus.context_id(name), indexes.ID_OF[table]
    found = indexes.vector_index(corpus, context, table)
    if found is not None:
        cells, also, without = found
        if without.isEmpty() and also.isEmpty():
            return cells.search_batch(queries, limit, min_similarity, id_col)
    return vector_search_batch(corpus.read(table, context).select(id_col, "embedding"), queries, limit, min_similarity, id_col)


def search(
    corpus: Corpus, name: str, query: str, mode: str = "hybrid", limit: int = 10, form: str = "standard", **options
) -> DataFrame:
    """Search a context. ``form`` is "standard" (with nested snippets and promoted metadata) or "compact"."""
    schema.check_choice(form, ("standard", "compact"), "form")
    context = corpus.context_id(name)
    if mode != "fulltext":
        options["embedder"] = options.get("embedder") or text_embedder()
        model, asked = corpus.embedding_model(name), getattr(options["embedder"], "name", None)
        if asked is not None and model != asked:
            raise ValueError(f"context {name!r} holds vectors of {model!r}, not of {asked!r}")
    found = _by_index(corpus, context, query, mode, limit, **options)
    if found is None:
        documents = corpus.read("documents", context)
        found = search_frames(corpus.read("chunks", context), documents, query, mode, limit, **options)
    # At most ``limit`` rows. Fetched once, the search does not run again for each use of its result.
    hits = corpus.spark.createDataFrame(found.collect(), found.schema)
    full = attach_snippets(hits, corpus.read("code_snippets", context))
    if form == "compact":
        return shaping.compact(full).orderBy(full["score"].desc(), "chunk_id")
    shaped = shaping.promote_metadata(shaping.standardize(full)).drop("doc_metadata")
    return shaped.orderBy(shaped["score"].desc(), "chunk_id")


def search_code(
    corpus: Corpus, name: str, query: str, mode: str = "hybrid", limit: int = 10, form: str = "standard", **options
) -> DataFrame:
    """Search the code snippets of a context."""
    schema.check_choice(form, ("standard", "compact"), "form")
    context = corpus.context_id(name)
    hits = search_code_frames(
        corpus.read("code_snippets", context), corpus.read("documents", context), query, mode, limit, **options
    )
    if form == "compact":
        return shaping.compact_code(hits).orderBy(hits["score"].desc(), "snippet_id")
    shaped = shaping.promote_code_metadata(shaping.standardize_code(hits))
    return shaped.orderBy(shaped["score"].desc(), "snippet_id")
