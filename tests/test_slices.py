"""Python functions hand on what they made slice by slice, and run once for a filter and its result."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from doclake.functions import html, text
from doclake.functions.vectors import ROWS_AT_ONCE, BatchEmbedder
from doclake.operators.fulltext import fulltext_hits
from doclake.operators.quality import filter_quality
from doclake.sources.pages import pages_to_markdown


def _python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_stems_in_slices(monkeypatch):
    monkeypatch.setattr(text, "WORDS_AT_ONCE", 3)
    rows = [["running"], [], ["dogs", "cats", "houses", "is"], ["a"], ["pages", "b"], []]
    lists = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    slices = list(text._stem_slices(lists))
    assert [x for s in slices for x in s.to_pylist()] == text._stem_batch(lists).to_pylist()
    assert len(slices) > 2 and max(len(s.flatten()) for s in slices) == 4  # a text is never cut


def test_stemmed_once(spark):
    df = spark.createDataFrame([(1, "dogs running"), (2, "a dog"), (3, "cats")], "doc_id int, content string")
    hits = fulltext_hits(df, "dogs", 10, "doc_id", stemming=True)
    assert _python_steps(hits) == 1
    assert {r["doc_id"] for r in hits.collect()} == {1, 2}


def test_vectors_in_slices(spark, monkeypatch):
    embedder = BatchEmbedder(lambda texts: [[float(t), 1.0] for t in texts], 2, batch=300)
    kept = {}
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: kept.setdefault("run", f) and (lambda column: column))
    embedder.vectors("content")
    texts = pa.array([None if i % 7 == 0 else str(i) for i in range(2500)])
    slices = list(kept["run"](iter([texts])))
    assert max(map(len, slices)) == 900 <= ROWS_AT_ONCE and sum(map(len, slices)) == 2500
    got = [v for s in slices for v in s.to_pylist()]
    assert got == [None if i % 7 == 0 else [float(np.float32(i)), 1.0] for i in range(2500)]


def test_pages_converted_once_and_in_slices(spark):
    page = F.when(F.col("id") % 5 != 0, F.concat(F.lit("<title>t</title><p>some words that make up a page "), "id"))
    pages = spark.range(0, 3 * html.PAGES_AT_ONCE + 1, 1, 1).select("id", F.lit("http://a/b").alias("url"), page.alias("html"))
    kept = filter_quality(pages_to_markdown(pages), 1)
    assert _python_steps(kept) == 1
    got = {r["id"]: r["markdown"] for r in kept.collect()}
    assert got == {i: f"some words that make up a page {i}" for i in range(3 * html.PAGES_AT_ONCE + 1) if i % 5}
