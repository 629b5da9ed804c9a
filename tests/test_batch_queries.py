"""Batch searches ask with every vector, in the query and in its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def asked_by_sql(name):
    connection = duckdb.connect()
    for table in ("embeddings", "documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    every = {i for (i,) in connection.execute("SELECT vec_id FROM embeddings").fetchall()}
    asked = {i for (i,) in connection.execute(f"SELECT DISTINCT query_id FROM ({entry.oracle_sql()[name]})").fetchall()}
    return every, asked


def test_vector_batch_asks_with_every_vector(spark):
    every, asked = asked_by_sql("vector_batch")
    got = entry.queries()["vector_batch"](spark, FOLDER).collect()
    assert asked == every
    assert {r["query_id"] for r in got} == every
    assert {r["query_id"] for r in got if r["vec_id"] == r["query_id"]} == every  # a vector is its own best hit, or ties with it


def test_hybrid_batch_asks_with_every_vector(spark):
    every, asked = asked_by_sql("hybrid_batch")
    got = entry.queries()["hybrid_batch"](spark, FOLDER).collect()
    assert every <= asked  # benchmark texts ask as well
    assert {r["query_id"] for r in got} == asked
    assert {r["query_id"] for r in got if r["doc_id"] == r["query_id"] and r["score"] >= 0.7} >= every


def test_cells_batch_asks_with_every_vector(spark):
    every, asked = asked_by_sql("cells_batch")
    got = entry.queries()["cells_batch"](spark, FOLDER).collect()
    assert asked == every
    assert {r["query_id"] for r in got} == every
    assert {r["query_id"] for r in got if r["chunk_id"] == r["query_id"]} == every


def test_cells_of_several_groups_equal_the_scan(spark, tmp_path, monkeypatch):
    """Every vector asks; copies fill cells that are cut into parts of several groups, and ties go by id across them."""
    import numpy as np

    from doclake.operators import cells as C
    from doclake.operators import vector_search as V

    monkeypatch.setattr(V, "LEAST_ROWS", 50)
    monkeypatch.setattr(C, "PART_ROWS", 40)
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((900, 8))
    vectors[::3] = vectors[1]  # 300 copies and one more
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(900), vectors)]
    items = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    C.build_cells(items, str(tmp_path / "index"), cells=12)
    asked = items.withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    unit = np.array([v for _, v in sorted(rows)], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = []
    for q in range(900):
        hits = np.lexsort((np.arange(900), -scores[q]))[:10]
        want += [(q, k + 1, int(i), scores[q, i]) for k, i in enumerate(hits) if scores[q, i] > 0.1]
    for got in (C.Cells(spark, str(tmp_path / "index")).search_batch(asked, 10, 0.1), V.vector_search_batch(items, asked, 10, 0.1)):
        assert [r[:3] for r in key(got)] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in key(got)], [r[3] for r in want], atol=2e-9)


def test_best_keeps_the_smallest_places_among_many_copies():
    """The bar of a batch search drops no tie that a smaller place wins, in whatever order the blocks come."""
    import numpy as np

    from doclake.operators.vector_search import Best

    rng = np.random.default_rng(3)
    scores = np.round(rng.random((40, 900)), 2)  # every score many times
    scores[:, ::7] = 0.995
    scores[5], scores[6, 4:] = np.nan, np.nan
    for order in (np.arange(9), np.arange(9)[::-1], rng.permutation(9)):
        best = Best(40, 10, 0.1)
        for block in order:
            at, of = np.arange(block, 900, 9), rng.permutation(40)
            best.see(scores[np.ix_(of, at)], at, of)
        q, at, s = best.settled()
        for k in range(40):
            good = np.flatnonzero(scores[k] > 0.1)
            want = good[np.lexsort((good, -scores[k, good]))[:10]]
            assert at[q == k].tolist() == want.tolist() and s[q == k].tolist() == scores[k, want].tolist()
