"""Merging stored contexts into a target."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.operators import merge as m
from doclake.session import discard, shared_dir
from doclake.sources.corpus import Corpus


def merge_contexts(
    corpus: Corpus, sources: list[str], target: str, mode: str = "union", now: datetime | None = None
) -> DataFrame:
    """Merge contexts by union or intersection; the target is created when absent. One row of counts.

    Only rows the target lacks are appended, so a repeated merge adds nothing twice. The merge becomes visible as a whole.
    """
    schema.check_choice(mode, schema.MERGE_MODES, "mode")
    ids = [corpus.context_id(s) for s in sources]
    with corpus.change() as version:
        return _merge(corpus, sources, ids, target, mode, now, version)


def _merge(
    corpus: Corpus, sources: list[str], ids: list[str], target: str, mode: str, now: datetime | None, version: int
) -> DataFrame:
    spark = corpus.spark
    if corpus.has_context(target):
        corpus.update_context(target, now)
    else:
        about = f"Merged from {', '.join(sources)}"
        models = {corpus.embedding_model(s) for s in sources}
        if len(models) > 1:
            raise ValueError(f"the contexts hold vectors of different models: {', '.join(sorted(map(str, models)))}")
        columns = "name string, description string, embedding_model string"
        corpus.register(spark.createDataFrame([(target, about, models.pop())], columns), now)
    into = corpus.context_id(target)

    work = shared_dir(spark, "merge")
    stored = {t: corpus.read(t, into) for t in ("documents", "raw_documents", "chunks", "code_snippets")}
    # Which documents, under which ids, is settled without their texts. All frames are planned before anything is
    # appended, and so keep to the files of now, also where the target is one of the sources.
    own = corpus.read("documents", ids)
    chosen = m.collect_documents(own.select("context_id", "doc_id", "url"), ids, mode)
    m.map_to_target(chosen, stored["documents"], into).write.parquet(f"{work}/documents")
    mapped = spark.read.parquet(f"{work}/documents")
    moves = m.id_map(mapped).where(F.col("doc_id") != F.col("new_doc_id"))

    def of_sources(table: str) -> DataFrame:
        return corpus.read(table, ids)

    snippets = of_sources("code_snippets")
    pairs = m.snippet_id_pairs(moves, snippets)
    new_snippets = m.copy_snippets(moves, snippets, stored["code_snippets"], into)
    new_chunks = m.copy_chunks(moves, of_sources("chunks"), stored["chunks"], into, pairs)
    raw = of_sources("raw_documents").join(moves, "doc_id").withColumn("doc_id", F.col("new_doc_id"))
    raw = raw.join(stored["raw_documents"].select("doc_id"), "doc_id", "left_anti")
    fresh = mapped.where("is_new").select("context_id", "doc_id", "new_doc_id", "is_new")
    fresh = own.join(fresh.join(m.new_names(own, pairs), "doc_id", "left"), ["context_id", "doc_id"])
    new_documents = m.documents_to_insert(m.renamed(fresh), into, stored["documents"].columns)

    corpus.append("code_snippets", new_snippets)
    corpus.append("chunks", new_chunks)
    corpus.append("raw_documents", raw.withColumn("context_id", F.lit(into)))
    corpus.append("documents", new_documents)

    added = {t: corpus.read(t, into, since=version - 1).count() for t in ("chunks", "code_snippets")}
    counts = (mapped.count(), added["chunks"], added["code_snippets"])
    discard(spark, work)
    return spark.createDataFrame(
        [(target, mode, len(sources), *counts)],
        "target string, mode string, source_contexts int, documents_merged long, chunks_merged long, "
        "code_snippets_merged long",
    )
