"""One-bit codes against brute force."""

import numpy as np
import pandas as pd
import pytest

from doclake.llm.ann import Estimator, _planes, QUERY_BITS, by_twenty, nearest, rotation, search_group

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    out = {}
    for q, query in rows:
        if q % 20 == 0:
            found = [(-(np.float64(v) * np.float64(query)).sum(), i) for i, v in rows if i != q and len(v) == len(query)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 70)).astype(np.float32)
    x += 0.5
    x[300:500] = x[7]
    return [(i, v) for i, v in enumerate(x)] + [(5000 + i, rng.standard_normal(3).astype(np.float32)) for i in range(50)]


def test_recall_order_and_scores(spark, rows):
    bad = [(9000, None, ""), (9020, [], ""), (9040, [0.0, 0.0], ""), (9060, [1.0, None], ""), (9080, [float("nan")], ""),
           (9100, [float("inf"), 1.0], ""), (None, [1.0, 2.0], "")]
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in rows] + bad, SCHEMA)
    got = nearest(df, by_twenty).toPandas()
    want = brute(rows, 20)
    assert set(got["query_id"]) == set(want)
    hits = total = 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        truth = dict(want[q])
        assert list(part["rank"]) == list(range(1, len(truth) + 1))
        pairs = list(zip(-part["score"], part["vec_id"]))
        assert pairs == sorted(pairs) and q not in set(part["vec_id"])
        for i, s in zip(part["vec_id"], part["score"]):
            if i in truth:
                assert s == pytest.approx(truth[i], abs=1e-12)
                hits += 1
        total += len(truth)
    assert hits / total >= 0.9
    # A query among many equal vectors: ties go to the smaller ids.
    assert list(got[got["query_id"] == 300].sort_values("rank")["vec_id"]) == [i for i, _ in want[300]]


def test_estimates_stay_inside_their_bounds():
    rng = np.random.default_rng(1)
    x, q, dim = rng.standard_normal((2000, 128)), rng.standard_normal(128), 128
    turn = rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    away = np.linalg.norm(x, axis=1)
    unit = x / away[:, None] @ turn
    codes = np.packbits(unit >= 0, axis=1, bitorder="little").view(np.uint64)
    est = Estimator(codes, away, np.abs(unit).sum(axis=1) / np.sqrt(dim), np.zeros(2000), dim)
    turned = q @ turn
    width = (turned.max() - turned.min()) / (2**QUERY_BITS - 1)
    rounded = np.rint((turned - turned.min()) / width).astype(int)
    value, error = est.upper(turned.min() + width * rounded, turned.min(), width, _planes(rounded, 2), np.linalg.norm(q))
    assert (np.abs(value - x @ q) <= error).mean() > 0.9


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), by_twenty).count() == 0
    assert search_group(pd.DataFrame(), pd.DataFrame(), 20).empty
