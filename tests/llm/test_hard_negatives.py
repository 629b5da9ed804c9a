"""Hard negatives against all scores sorted."""

import math
import random

import numpy as np
import pytest

from doclake.llm.hard_negatives import best, mine_table, products

SCHEMA = "vec_id long, embedding array<float>, label int, limits string, rank string, dim int, slot int"


def brute(rows):
    ok = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        new = ((label + 1) % 10 if vec_id % 7 == 0 else label, list(np.array(vector, np.float32).astype(float)))
        ok[vec_id] = min(ok.get(vec_id, new), new)
    ints = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in ok.items()}
    out = []
    for anchor, (label, v) in ints.items():
        if anchor % 100:
            continue
        scores = sorted(
            (-sum(a * b for a, b in zip(v, w)), k, other == label)
            for k, (other, w) in ints.items()
            if k != anchor and len(w) == len(v)
        )
        for minus, positive, _ in [s for s in scores if s[2]][:5]:
            inside = [s for s in scores if not s[2] and -30 * minus <= -100 * s[0] <= -90 * minus][:10]
            out += [(anchor, positive, i + 1, k, -minus, -score) for i, (score, k, _) in enumerate(inside)]
    return sorted(out)


def check(spark, rows, block_rows=50):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    got = mine_table(df, block_rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.4, 0.7, rng.random()]) for _ in range(6)], rng.randrange(10)) for i in range(900)]
    rows += [(2000 + i, [0.4] * 6, i % 10) for i in range(400)]  # one vector over and over
    rows += [(100, [0.1] * 6, 3), (55, [0.2] * 6, 1), (55, [0.2] * 6, 1), (1300, [0.3, 0.3], 1), (1301, [0.2, 0.3], 1), (1302, [0.1, 0.1], 4)]
    odd = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.0] * 6, [-1.0] * 6]
    rows += [(3000 + i, v, 2) for i, v in enumerate(odd)] + [(None, [0.1] * 6, 1), (3100, [0.1] * 6, None)]
    rng.shuffle(rows)
    assert len(check(spark, rows)) > 300


def test_empty_and_alone(spark):
    assert check(spark, []) == []
    assert check(spark, [(100, [1.0, 2.0], 1)]) == []
    assert check(spark, [(100, [1.0, 2.0], 1), (101, [-1.0, -2.0], 1), (102, [0.0, 0.0], 2)]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.random() * 1e6 for _ in range(3)], i % 3) for i in range(230)])
    a = np.array([[2.0**40, 1.0]])
    assert products(a, a)[0, 0] == (1 << 63) - 1


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_keeps_order_of_ties(k):
    scores = np.random.default_rng(1).integers(0, 4, 40)
    assert best(scores, k).tolist() == sorted(range(40), key=lambda i: (-scores[i], i))[:k]
