import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.operators import ann
from doclake.operators import fulltext as FT
from doclake.operators import hybrid as H
from doclake.operators import vector_search as V
from doclake.plans.search import search_frames

RNG = np.random.default_rng(5)
VECTORS = RNG.normal(size=(300, 16)).astype(np.float32)
VECTORS[250:] = VECTORS[0]  # a group of copies


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(VECTORS)] + [(900, None), (901, [0.0] * 16), (902, [1.0])]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)


def exact(query, k, floor=-1.0):
    v = VECTORS.astype(np.float64)
    q = np.asarray(query, dtype=np.float64)
    s = v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)
    order = sorted(range(len(s)), key=lambda i: (-round(s[i], 9), i))
    return [i for i in order if s[i] > floor][:k]


def test_vector_hits_with_ties(items):
    got = [r["chunk_id"] for r in V.vector_hits(items, VECTORS[0].tolist(), 20, -1.0).collect()]
    assert got == exact(VECTORS[0], 20)
    assert {r["chunk_id"] for r in V.vector_hits(items, [0.0] * 16, 5, -1.0).collect()} == set()


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_batch_equals_single_queries(spark, items, block_rows):
    rows = [(q, VECTORS[q].tolist()) for q in range(12)] + [(50, None)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    got = V.vector_search_batch(items, queries, 7, 0.0, block_rows=block_rows).collect()
    for q in range(12):
        mine = [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == exact(VECTORS[q], 7, 0.0)
    assert all(r["query_id"] < 12 for r in got)


def test_cells(spark, items, tmp_path):
    model = ann.build_ivf(items, str(tmp_path / "cells"), 8)
    index = spark.read.parquet(str(tmp_path / "cells"))
    assert index.count() == 300
    found = total = 0
    for q in range(1, 30):
        want = exact(VECTORS[q], 10)
        got = {r["chunk_id"] for r in ann.ivf_search(index, model, VECTORS[q].tolist(), 4, 10, -1.0).collect()}
        found, total = found + len(got & set(want)), total + 10
    assert found / total > 0.6
    every = ann.ivf_search(index, model, VECTORS[3].tolist(), 8, 10, -1.0)
    assert [r["chunk_id"] for r in every.collect()] == exact(VECTORS[3], 10)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        ("a", "Spark joins tables. Tables are joined."),
        ("b", "A table and a join"),
        ("c", "nothing to see"),
        ("d", "joins joins tables"),
        ("e", None),
    ]
    return spark.createDataFrame(rows, "chunk_id string, content string")


def test_all_lexemes_are_needed(texts):
    assert [r["chunk_id"] for r in FT.fulltext_hits(texts, "the tables joins").collect()] == ["d", "a"]
    stemmed = {r["chunk_id"] for r in FT.fulltext_hits(texts, "tables joins", stemming=True).collect()}
    assert stemmed == {"a", "b", "d"}
    assert FT.fulltext_hits(texts, "the of").count() == 0
    assert all(0 <= r["score"] < 1 for r in FT.fulltext_hits(texts, "joins").collect())


def test_postings_equal_the_scan(spark, texts, tmp_path):
    FT.write_postings(FT.build_postings(texts), str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    stats = FT.posting_statistics(postings, texts).first()
    for query in ("joins", "tables joins", "spark", "absent joins", "the"):
        scan = [(r["chunk_id"], round(r["score"], 9)) for r in FT.fulltext_hits(texts, query).collect()]
        index = [(r["chunk_id"], round(r["score"], 9)) for r in FT.postings_search(postings, stats, query).collect()]
        assert scan == index
    queries = spark.createDataFrame([(1, "tables joins"), (2, "spark"), (3, "absent")], "query_id long, text string")
    batch = FT.fulltext_search_batch(postings, stats, queries).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in batch} == {(1, "a"), (1, "d"), (2, "a")}
    row = postings.where("lexeme = 'tables' and chunk_id = 'a'").first()
    assert (row["tf"], row["positions"], row["text_length"]) == (2, [2, 3], 5)


def test_merge_of_hits(spark):
    v = spark.createDataFrame([("x", 0.9), ("y", 0.3)], "chunk_id string, score double")
    f = spark.createDataFrame([("z", 0.7), ("y", 0.5), ("w", 0.7)], "chunk_id string, score double")
    got = [(r["chunk_id"], round(r["score"], 6)) for r in H.merge_hits(v, f, 10).collect()]
    assert got == [("x", 0.63), ("y", 0.36), ("w", 0.21), ("z", 0.21)]
    tie = [(r["chunk_id"]) for r in H.merge_hits(v.where("chunk_id = 'y'"), f.where("chunk_id = 'z'"), 10).collect()]
    assert tie == ["y", "z"]  # 0.21 each: the vector hit comes first


def test_dispatch_checks(texts):
    docs = texts.select(F.col("chunk_id").alias("doc_id"))
    for bad in ({"mode": "fuzzy"}, {"query": "  "}, {"limit": 0}, {"limit": -1}):
        args = {"query": "x", "mode": "fulltext", "limit": 5, **bad}
        with pytest.raises(ValueError):
            search_frames(texts, docs, args["query"], args["mode"], args["limit"])


def test_batch_blocks_are_scored_in_steps(monkeypatch):
    """Queries of a block come in steps; ties go by id across steps and matrix blocks."""
    import numpy as np
    import pyarrow as pa

    from doclake.operators import vector_search as V

    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 4)).astype(np.float32)
    vectors[1100:1110] = vectors[:10]  # equal vectors in another matrix block
    ids = rng.permutation(1500)
    column = pa.array(vectors.tolist(), pa.list_(pa.float32()))
    items = pa.table({"id": pa.array(ids), "embedding": column})
    queries = pa.table({"query_id": pa.array(range(10)), "embedding": column.slice(0, 10)})
    got = V._block_top(items, queries, 5, 0.1, "id").to_pylist()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in range(10):
        scores = np.round(unit @ unit[q], 9)
        want = ids[np.lexsort((ids, -scores))[:5]].tolist()
        assert [r["id"] for r in got if r["query_id"] == q] == want
