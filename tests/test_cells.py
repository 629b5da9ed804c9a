"""Search through cells against a scan of all vectors."""

import numpy as np
import pytest

from doclake.operators.cells import Cells, build_cells
from doclake.operators.vector_search import vector_hits, vector_search_batch


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    # Half of the vectors lie round one centre; ties, a zero vector and one of another size.
    of = np.where(rng.random(1500) < 0.5, 0, rng.integers(0, 12, 1500))
    vectors = centres[of] + 0.25 * rng.standard_normal((1500, 16))
    vectors[700:720] = vectors[3]
    rows = [(f"c{i:05d}", f"d{i % 90}", v.tolist()) for i, v in enumerate(vectors)]
    rows += [("zero", "d0", [0.0] * 16), ("short", "d0", [1.0, 2.0]), ("none", "d0", None)]
    items = spark.createDataFrame(rows, "chunk_id string, doc_id string, embedding array<float>")
    path = str(tmp_path_factory.mktemp("cells") / "index")
    build_cells(items, path, cells=20)
    queries = np.concatenate([vectors[[3, 10, 500]], centres[:4], rng.standard_normal((5, 16))])
    return items, Cells(spark, path), queries


def rows_of(df):
    return [(r["chunk_id"], round(r["score"], 9)) for r in df.collect()]


def test_every_query_equals_the_scan(indexed):
    items, cells, queries = indexed
    shares = []
    for q in queries:
        for limit, floor in ((10, 0.1), (30, -1.0), (3, 0.9)):
            got, share = cells.search(q.tolist(), limit, floor)
            assert rows_of(got) == rows_of(vector_hits(items, q.tolist(), limit, floor))
            shares.append(share)
    assert min(shares) < 0.3 and max(shares) <= 1.0


def test_batch_equals_the_scan(spark, indexed, monkeypatch):
    from doclake.operators import cells as C

    items, cells, queries = indexed
    monkeypatch.setattr(C, "PART_ROWS", 100)  # crowded cells are cut
    rows = [(k, q.tolist()) for k, q in enumerate(queries)] + [(90, [0.0] * 16), (91, [1.0, 2.0]), (92, None)]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    for limit, floor in ((10, 0.1), (40, 0.5)):
        want = [r for r in key(vector_search_batch(items, asked, limit, floor)) if r[0] != 91]
        assert key(cells.search_batch(asked, limit, floor)) == want


def test_newer_and_forgotten_vectors(spark, indexed):
    items, cells, queries = indexed
    new = spark.createDataFrame([("new", queries[0].tolist())], "chunk_id string, embedding array<float>")
    gone = spark.createDataFrame([("d3",), ("d7",)], "doc_id string")
    live = items.join(gone, "doc_id", "left_anti").select("chunk_id", "embedding").unionByName(new)
    for q in queries[:5]:
        assert rows_of(cells.search(q.tolist(), 10, 0.1, also=new, without=gone)[0]) == rows_of(vector_hits(live, q.tolist(), 10, 0.1))


def test_queries_that_fit_no_vector(indexed):
    items, cells, _ = indexed
    assert cells.search([0.0] * 16, 5)[0].count() == 0
    assert cells.search([1.0, 2.0], 5)[0].count() == 0
