"""Hybrid ranking: weighted sum of vector and full-text scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.operators.fulltext import fulltext_hits
from doclake.operators.vector_search import (
    CHUNK_COLUMNS,
    LIMIT,
    SCORE_DIGITS,
    SEARCH_MIN_SIMILARITY,
    best_per_query,
    code_fields,
    ranked,
    vector_hits,
    with_document,
)

WEIGHTS = (0.7, 0.3)


def merge_hits(
    vector: DataFrame,
    fulltext: DataFrame,
    limit: int = LIMIT,
    weights: tuple[float, float] = WEIGHTS,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Merge two short hit lists by id; a missing score counts as 0.

    Equal hybrid scores keep list order: vector hits first in their order, then text-only hits in theirs, then id.
    Both lists are limited already, so this aggregates a few rows.
    """
    none = F.lit(None).cast("double")
    both = vector.select(id_col, F.col("score").alias("_v"), none.alias("_f")).unionByName(
        fulltext.select(id_col, none.alias("_v"), F.col("score").alias("_f"))
    )
    merged = both.groupBy(id_col).agg(F.max("_v").alias("_v"), F.max("_f").alias("_f"))
    zero = F.lit(0.0)
    scored = merged.select(
        id_col,
        "_v",
        F.coalesce("_v", zero).alias("vector_score"),
        F.coalesce("_f", zero).alias("fulltext_score"),
    ).withColumn("hybrid_score", F.col("vector_score") * weights[0] + F.col("fulltext_score") * weights[1])
    digits = lambda c: F.round(c, SCORE_DIGITS)
    order = [digits("hybrid_score").desc(), digits("_v").desc_nulls_last(), digits("fulltext_score").desc()]
    return scored.orderBy(*order, id_col).limit(limit).drop("_v").withColumn("score", F.col("hybrid_score"))


def hybrid_hits(
    items: DataFrame,
    query: str,
    vector: Sequence[float],
    limit: int = LIMIT,
    weights: tuple[float, float] = WEIGHTS,
    id_col: str = "chunk_id",
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    **options,
) -> DataFrame:
    """Twice the wanted number of hits from each side, merged."""
    by_vector = vector_hits(items, vector, 2 * limit, min_similarity, id_col)
    by_text = fulltext_hits(items, query, 2 * limit, id_col, **options)
    return merge_hits(by_vector, by_text, limit, weights, id_col)


def hybrid_search(
    chunks: DataFrame,
    documents: DataFrame,
    query: str,
    vector: Sequence[float],
    limit: int = LIMIT,
    weights: tuple[float, float] = WEIGHTS,
    **options,
) -> DataFrame:
    """Best chunks by hybrid score, with the fields of their documents."""
    hits = hybrid_hits(chunks, query, vector, limit, weights, **options)
    columns = [c for c in CHUNK_COLUMNS if c in chunks.columns]
    detailed = chunks.select("chunk_id", "doc_id", *columns).join(hits, "chunk_id")
    return ranked(with_document(ranked(detailed, limit), documents), limit)


def hybrid_search_code(
    snippets: DataFrame,
    documents: DataFrame,
    query: str,
    vector: Sequence[float],
    limit: int = LIMIT,
    weights: tuple[float, float] = WEIGHTS,
    **options,
) -> DataFrame:
    hits = hybrid_hits(snippets, query, vector, limit, weights, "snippet_id", **options)
    columns = [c for c in ("content", "metadata") if c in snippets.columns]
    detailed = snippets.select("snippet_id", "doc_id", *columns).join(hits, "snippet_id")
    return ranked(code_fields(ranked(detailed, limit, "snippet_id"), documents), limit, "snippet_id")


def hybrid_batch(
    vector: DataFrame,
    fulltext: DataFrame,
    limit: int = LIMIT,
    weights: tuple[float, float] = WEIGHTS,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Hybrid ranking of batch results (query_id, id, score) of both kinds, each twice as long as ``limit``."""
    none = F.lit(None).cast("double")
    both = vector.select("query_id", id_col, F.col("score").alias("_v"), none.alias("_f")).unionByName(
        fulltext.select("query_id", id_col, none.alias("_v"), F.col("score").alias("_f"))
    )
    merged = both.groupBy("query_id", id_col).agg(F.max("_v").alias("_v"), F.max("_f").alias("_f"))
    value = F.coalesce("_v", F.lit(0.0)) * weights[0] + F.coalesce("_f", F.lit(0.0)) * weights[1]
    return best_per_query(merged.select("query_id", id_col, value.alias("score")), limit, id_col)
