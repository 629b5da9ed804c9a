"""The indexed search as a query: texts are moved once, and documents without a language are stored as well."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from doclake.plans import indexes
from doclake.sources.corpus import Corpus


def test_documents_without_a_language_are_found(spark, tmp_path):
    docs = [(i, f"text {i} " * 20, (None, "fr", "en")[i % 3], "src") for i in range(12)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(i), 0.5], 0) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = entry.queries()["search_indexed"](spark, str(tmp_path)).collect()
    assert [h["chunk_id"] for h in sorted(hits, key=lambda h: -h["score"])] == [str(i) for i in range(10)]


def test_texts_are_not_shuffled_to_meet_the_hits(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path), buckets=2)
    corpus.register(spark.createDataFrame([("c",)], "name string"))
    owner = F.lit(corpus.context_id("c")).alias("context_id")
    ids = spark.range(20).select(owner, F.col("id").cast("string").alias("doc_id"))
    with corpus.change():
        corpus.append("documents", ids.withColumn("title", F.lit("t")))
        corpus.append("chunks", ids.select("*", F.col("doc_id").alias("chunk_id"), F.lit("x").alias("content")))
    frames, plain = [], indexes.ranked
    monkeypatch.setattr(indexes, "ranked", lambda df, limit: frames.append(df) or plain(df, limit))
    hits = spark.createDataFrame([("3", 0.5), ("7", 0.25)], "chunk_id string, score double")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # so that nothing is small but what is known to be
    try:
        found = indexes.with_fields(corpus, corpus.context_id("c"), hits, 5).collect()
        plan = frames[0]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert [h["doc_id"] for h in found] == ["3", "7"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
