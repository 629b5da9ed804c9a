"""Held-out accuracy, the risk's gradient, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from doclake.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, score double"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    clean = ["able", "thing", "ention", "orange", "neither", "laser", "foundation", "mentor"]
    bad = ["idiot", "trash", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        words = [rng.choice(clean) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(3, 80))]
        if toxic:
            words += [rng.choice(bad) + rng.choice(["", "s", "!", "ally"]) for _ in range(rng.randint(2, 4))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", 0.0))
        if rng.random() < 0.6:
            labels.append((i, int(toxic), 1))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    odd = [(5000, "", "", 0.0), (5001, None, None, None), (5002, "idiot trash scumbag moronic " * 20000, "", 0.0), (None, "a", "", 0.0), (7, rows[7][1], "", 0.0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = T.score(docs, T.fit(docs, marks)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(t, by_id[i].predicted) for i, t, _ in labels if by_id[i].held_out]
    assert np.mean([p for t, p in held if t]) >= 0.9
    assert np.mean([p for t, p in held if not t]) <= 0.02
    assert by_id[5002].predicted == 1 and by_id[5000].predicted == 0
    kept = T.drop_toxic(docs, T.fit(docs, marks))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if not r.predicted)


def test_held_out_labels_are_never_read(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    held = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, q) for i, t, q in labels]
    one, two = (T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int, quality int")) for x in (labels, held))
    assert np.array_equal(one.features, two.features) and np.array_equal(one.weights, two.weights)
    assert (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)


def test_training_and_scoring_see_the_same_features():
    texts = pa.array(["One two, one!", "", None, "internationally two"])
    owner, feature = T.text_features(texts)
    model = T.Model(np.unique(feature), np.arange(1.0, len(np.unique(feature)) + 1), 0.5)
    weight = dict(zip(model.features, model.weights))
    want = [0.5 + sum(weight[f] for o, f in zip(owner, feature) if o == i) for i in range(4)]
    assert np.allclose(T.logits(model, texts), want)


def test_risk_and_its_slopes_by_finite_differences():
    rng = np.random.default_rng(3)
    for prior, shift in ((0.1, 0.0), (0.3, 1.0), (0.9, -3.0)):
        p, u = rng.standard_normal(7) + 1, rng.standard_normal(11) + shift
        part = np.mean(np.log1p(np.exp(u))) - prior * np.mean(np.log1p(np.exp(p)))
        assert T.risk(p, u, prior) == pytest.approx(prior * np.mean(np.log1p(np.exp(-p))) + max(0, part))
        # Where the second part is negative its reverse is followed, away from zero slope.
        aim = (lambda p, u: T.risk(p, u, prior)) if part >= 0 else (
            lambda p, u: -(np.mean(np.logaddexp(0, u)) - prior * np.mean(np.logaddexp(0, p))))
        slopes = np.concatenate(T.risk_slopes(p, u, prior))
        both, step = np.concatenate([p, u]), 1e-6
        for k in range(len(both)):
            up, down = both.copy(), both.copy()
            up[k] += step
            down[k] -= step
            change = (aim(up[:7], up[7:]) - aim(down[:7], down[7:])) / (2 * step)
            assert slopes[k] == pytest.approx(change, abs=1e-6)


def test_training_comes_near_a_plain_full_batch_trainer():
    """Mini-batches end at a risk close to that of plain projected gradient descent over all rows."""
    rng = np.random.default_rng(5)
    n, k, prior = 20000, 12, 0.2
    toxic = rng.random(n) < prior
    hit = rng.random((n, k)) < np.where(toxic[:, None], 0.3, 0.03)
    owner, feature = np.nonzero(hit)
    positive, unlabelled = np.flatnonzero(toxic)[:1000], np.arange(n)
    model, weights = T.train(np.arange(k), owner, feature, positive, unlabelled, prior)
    w, b = np.zeros(k), np.log(prior / (1 - prior))
    for _ in range(3000):
        cp, cu = T.risk_slopes(hit[positive] @ w + b, hit @ w + b, prior)
        w = np.maximum(0, w - 0.5 * (hit[positive].T @ cp + hit.T @ cu + T.SHRINK * w))
        b -= 0.5 * (cp.sum() + cu.sum())
    plain = T.risk(hit[positive] @ w + b, hit @ w + b, prior)
    assert T.risk(hit[positive] @ weights + model.bias, hit @ weights + model.bias, prior) <= 1.05 * plain


def test_features_are_counted_over_all_texts(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows + [(9000, None, "", 0.0), (9001, "", "", 0.0)], SCHEMA)
    owner, feature = T.text_features(pa.array([r[1] for r in rows]))
    some = np.unique(feature)[::3]
    counts, n = T.count_features(docs, some)
    assert n == len(rows) + 2 and counts.tolist() == [int((feature == f).sum()) for f in some]


def test_odd_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, marks)
    assert T.score(docs, model).count() == 0
    some = spark.createDataFrame([(1, "a", "", 0.0)], SCHEMA)
    assert T.score(some, model).first().score < 1e-6
    assert T.score(some, T.fit(docs, spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int"))).count() == 1
