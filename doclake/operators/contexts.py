"""Contexts: registration, listing, deletion, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.operators.relations import first_per_key


def _moment(now: datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def register_contexts(existing: DataFrame, incoming: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Incoming (name, description, embedding_model) as context rows with a status.

    "created" may be appended; "exists" clashes with a stored name or an earlier row of the frame; "invalid" has no
    name of 1 to 100 characters.
    """
    optional = lambda c, default: (
        F.coalesce(F.col(c), F.lit(default)) if c in incoming.columns else F.lit(default)
    ).alias(c)
    rows = incoming.select(
        schema.context_id("name").alias("context_id"),
        "name",
        optional("description", ""),
        optional("embedding_model", schema.DEFAULT_EMBEDDING_MODEL),
        _moment(now).alias("created_at"),
        _moment(now).alias("updated_at"),
    )
    valid = F.col("name").isNotNull() & F.length("name").between(1, 100)
    taken = existing.select("context_id", F.lit(True).alias("_taken"))
    ranked = first_per_key(rows, ["context_id"], [F.col("description"), F.col("embedding_model")])
    status = F.when(~valid, "invalid").when(F.col("_taken"), "exists").otherwise("created")
    return ranked.join(taken, "context_id", "left").withColumn("status", status).drop("_taken")


def list_contexts(contexts: DataFrame, documents: DataFrame, name: str | None = None) -> DataFrame:
    """Contexts, newest first, with document count and text size."""
    chosen = contexts if name is None else contexts.where(F.col("name") == name)
    counts = documents.groupBy("context_id").agg(
        F.count("*").alias("document_count"), F.sum(schema.text_size(documents, "content_bytes")).alias("_bytes")
    )
    size = F.round(F.coalesce("_bytes", F.lit(0)) / (1024 * 1024), 6)
    return (
        chosen.join(counts, "context_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)))
        .withColumn("size_mb", size)
        .drop("_bytes")
        .orderBy(F.desc("created_at"), "name")
    )


def delete_context(table: DataFrame, context: str | Column) -> DataFrame:
    """A corpus table without the rows of one context; apply to every table for the cascade."""
    wanted = F.lit(context) if isinstance(context, str) else context
    return table.where(~F.col("context_id").eqNullSafe(wanted))


def corpus_stats(contexts: DataFrame, documents: DataFrame, chunks: DataFrame, snippets: DataFrame) -> DataFrame:
    """Documents, chunks, snippets and tokens per context."""
    # Each table is reduced to one row per context before anything is joined.
    parts = [
        documents.groupBy("context_id").agg(F.count("*").alias("documents")),
        chunks.groupBy("context_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")),
        snippets.groupBy("context_id").agg(F.count("*").alias("code_snippets")),
    ]
    out = contexts.select("context_id", "name")
    for part in parts:
        out = out.join(part, "context_id", "left")
    return out.fillna(0, ["documents", "chunks", "tokens", "code_snippets"])
