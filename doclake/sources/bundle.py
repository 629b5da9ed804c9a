"""Export of a context to a bundle of files, and import of such a bundle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.operators import merge as m
from doclake.sources.corpus import Corpus

SCHEMA_VERSION = "1.0"
BUNDLE_TABLES = ("documents", "raw_documents", "chunks", "code_snippets")
FORMATS = ("json", "parquet")


def manifest(context: DataFrame, tables: dict[str, DataFrame], now: datetime | Column | None = None) -> DataFrame:
    """One row: the context's name and description, totals, export time and format version."""
    moment = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    tagged = None
    for table, df in tables.items():
        part = df.select("context_id", F.lit(table).alias("table"))
        tagged = part if tagged is None else tagged.unionByName(part)
    totals = tagged.groupBy("context_id").agg(
        *[F.count_if(F.col("table") == t).alias(f"total_{t}") for t in tables]
    )
    named = context.select("context_id", "name", "description", "embedding_model")
    return (
        named.join(totals, "context_id", "left")
        .fillna(0, [f"total_{t}" for t in tables])
        .withColumn("export_timestamp", moment)
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
    )


def export_context(corpus: Corpus, name: str, path: str, form: str = "json", now: datetime | None = None) -> DataFrame:
    """Write a context's row, documents, raw texts, chunks, snippets and a manifest below ``path``."""
    schema.check_choice(form, FORMATS, "format")
    context = corpus.context_id(name)
    own = corpus.read("contexts").where(F.col("context_id") == context)
    tables = {t: corpus.read(t, context) for t in BUNDLE_TABLES}
    for table, df in {**tables, "contexts": own}.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{table}")
    summary = manifest(own, {t: tables[t] for t in ("documents", "chunks", "code_snippets")}, now)
    summary.write.mode("overwrite").format(form).save(f"{path}/manifest")
    return summary


def read_bundle(spark, path: str, form: str = "json") -> dict[str, DataFrame]:
    extra = {"code_snippets": ", summary string"} if form == "json" else {}
    return {
        t: spark.read.schema(schema.TABLES[t] + extra.get(t, "")).format(form).load(f"{path}/{t}")
        for t in (*BUNDLE_TABLES, "contexts")
    }


def remap_bundle(tables: dict[str, DataFrame], context: str) -> dict[str, DataFrame]:
    """Bundle rows under the ids of the importing context, defaults filled in.

    Inner joins with the document ids leave out children whose document is not in the bundle.
    """
    documents = tables["documents"]
    ids = documents.select("doc_id", schema.document_id(F.lit(context), F.col("url")).alias("new_doc_id"))
    snippets = tables["code_snippets"].withColumn("snippet_type", F.coalesce("snippet_type", F.lit("code_block")))
    if "summary" in snippets.columns:
        snippets = snippets.withColumn("preview", F.coalesce("preview", "summary")).drop("summary")
    snippets = snippets.withColumn("preview", F.coalesce("preview", F.lit("")))
    pairs = m.snippet_id_pairs(ids, snippets)
    moved = m.remap_snippets(documents, pairs).withColumn("doc_id", schema.document_id(F.lit(context), F.col("url")))
    raw = tables["raw_documents"].join(ids, "doc_id").withColumn("doc_id", F.col("new_doc_id"))
    owner = F.lit(context)
    return {
        "documents": moved.withColumn("context_id", owner).select(*documents.columns),
        "raw_documents": raw.withColumn("context_id", owner).select(*tables["raw_documents"].columns),
        "chunks": m.copy_chunks(ids, tables["chunks"], tables["chunks"].limit(0), context, pairs),
        "code_snippets": m.copy_snippets(ids, snippets, snippets.limit(0), context),
    }


def import_context(
    corpus: Corpus,
    path: str,
    overwrite: bool = False,
    form: str = "json",
    name: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Import a bundle. A taken name is an error unless ``overwrite``, which deletes that context first.

    One row with the number of rows imported per table.
    """
    schema.check_choice(form, FORMATS, "format")
    spark = corpus.spark
    tables = read_bundle(spark, path, form)
    row = tables["contexts"].first()
    if row is None:
        raise ValueError(f"no context in the bundle at {path}")
    target = name or row["name"]
    taken = corpus.has_context(target)
    if taken and not overwrite:
        raise ValueError(f"context {target!r} exists; use overwrite=True to replace it")

    context = _id_of(spark, target)
    moved = remap_bundle(tables, context)
    described = [(target, row["description"], row["embedding_model"] or schema.DEFAULT_EMBEDDING_MODEL)]
    # One version: the old context gives way to the imported one in a single step. Rows go from the bundle straight into
    # the corpus; an import that stops leaves rows that no reader counts.
    with corpus.change():
        if taken:
            corpus.delete_context(target)
        corpus.register(spark.createDataFrame(described, "name string, description string, embedding_model string"), now)
        for table in BUNDLE_TABLES:
            corpus.append(table, moved[table])
        counts = {t: corpus.read(t, context).count() for t in ("documents", "chunks", "code_snippets")}
    return spark.createDataFrame(
        [(target, counts["documents"], counts["chunks"], counts["code_snippets"])],
        "context_name string, documents_imported long, chunks_imported long, code_snippets_imported long",
    )


def _id_of(spark, name: str) -> str:
    return spark.range(1).select(schema.context_id(F.lit(name)).alias("id")).first()["id"]
