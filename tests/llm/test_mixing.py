"""Raking against numpy, marginals of the drawn sample, odd tables."""

import random

import numpy as np
import pytest

from doclake.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, weight string"


def brute(rows):
    """Mass of cells, raked in the same order of dimensions to tempered targets."""
    mass = {}
    for _, text, lang, source, topic in rows:
        key = (source or "unknown", lang or "unknown", topic)
        mass[key] = mass.get(key, 0) + len((text or "").split())
    mass = {k: v for k, v in mass.items() if v}
    total = lambda i, w: {c: sum(mass[k] * w[k] for k in mass if k[i] == c) for c in {k[i] for k in mass}}
    ones = dict.fromkeys(mass, 1.0)
    target = []
    for i, d in enumerate(M.DIMENSIONS):
        raised = {c: m ** M.POWERS[d] for c, m in total(i, ones).items()}
        target.append({c: v / sum(raised.values()) for c, v in raised.items()})
    weight, before = ones, float("inf")
    while True:
        for i in range(3):
            now = total(i, weight)
            weight = {k: w * target[i][k[i]] / now[k[i]] for k, w in weight.items()}
        worst = max(abs(total(i, weight)[c] / t - 1) for i in range(3) for c, t in target[i].items())
        if worst <= M.TOLERANCE or worst > before * (1 - M.LEAST_GAIN):
            break
        before = worst
    return weight, target, mass


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(6000):
        source = "big" if rng.random() < 0.5 else f"s{rng.randint(0, 4)}"
        lang = rng.choice(["en", "en", "en", "fr" if source != "s1" else "en"])
        topic = rng.choice(["prose", "prose", "numeric"])
        word = "12 " if topic == "numeric" else "word "
        out.append((i, word * rng.randint(1, 60), lang, source, topic))
    return out


def test_raking_matches_numpy(spark, rows):
    weight, target, mass = brute(rows)
    got = M.mix(spark.createDataFrame([(*r[:4], "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    top = max(weight.values())
    for r in got:
        key = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(weight[key], rel=1e-6)
        assert r.probability == pytest.approx(weight[key] / top, rel=1e-6)
    kept = [r for r in got if r.kept]
    total = sum(r.n_tokens for r in kept)
    for i, d in enumerate(M.DIMENSIONS):
        for c, share in target[i].items():
            assert sum(r.n_tokens for r in kept if r[d] == c) / total == pytest.approx(share, abs=0.03)
    assert sum(r.n_tokens for r in got) == sum(mass.values())


def test_documents_drawn_are_those_marked(spark, rows):
    df = spark.createDataFrame([(*r[:4], "x") for r in rows], SCHEMA)
    marked = {r.doc_id for r in M.mix(df).where("kept").collect()}
    drawn = M.mixed_documents(df)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == marked


def test_given_targets(spark, rows):
    df = spark.createDataFrame([(*r[:4], "x") for r in rows], SCHEMA)
    share = lambda name, pairs: spark.createDataFrame(pairs, f"{name} string, target double")
    targets = {
        "source": share("source", [("big", 0.2)] + [(f"s{i}", 0.16) for i in range(5)]),
        "lang": share("lang", [("en", 0.6), ("fr", 0.4)]),
        "topic": share("topic", [("prose", 0.5), ("numeric", 0.5)]),
    }
    got = M.mix(df, targets=targets).collect()
    expected = sum(r.n_tokens * r.probability for r in got)
    for d, want in (("source", {"big": 0.2, "s1": 0.16}), ("lang", {"fr": 0.4}), ("topic", {"prose": 0.5})):
        for c, s in want.items():
            assert sum(r.n_tokens * r.probability for r in got if r[d] == c) / expected == pytest.approx(s, rel=1e-3)


def test_contradictory_targets_leave_an_error_that_is_told(spark):
    """Sources of one language each: the language follows from the source, so not both targets can be met."""
    rows = [(i, "word " * (10 + i % 7), f"l{i % 3}", f"s{i % 3}", "x") for i in range(300)]
    share = lambda name, shares: spark.createDataFrame([(f"{name[0]}{k}", v) for k, v in enumerate(shares)], f"{name} string, target double")
    targets = {"source": share("source", [0.6, 0.3, 0.1]), "lang": share("lang", [0.2, 0.3, 0.5]), "topic": spark.createDataFrame([("prose", 1.0)], "topic string, target double")}
    got = M.mix(spark.createDataFrame(rows, SCHEMA), targets=targets).first()
    assert got.off_source == pytest.approx(4.0, rel=1e-6) and got.off_lang < 1e-6 and got.off_topic < 1e-6


def test_one_row_of_a_rare_source_does_not_thin_out_the_others(spark):
    rows = [(i, "word " * 50, "en", f"s{i % 20}", "x") for i in range(4000)] + [(4000, "word " * 20, "en", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(df).collect()
    total = sum(r.n_tokens for r in got)
    drawn = [r.n_tokens * r.copies for r in got]
    assert sum(drawn) / total == pytest.approx(M.KEPT, abs=0.03)
    assert M.kept_share(M.fitted(M.features(df))) == pytest.approx(M.KEPT, rel=1e-6)
    odd = got[[r.doc_id for r in got].index(4000)]
    share = {None: 20 / total} | {f"s{k}": (1 - 20 / total) / 20 for k in range(20)}
    target = share[None] ** M.POWERS["source"] / sum(v ** M.POWERS["source"] for v in share.values())
    assert odd.probability > 1 and odd.copies in (int(odd.probability), int(odd.probability) + 1)
    expected = sum(r.n_tokens * r.probability for r in got)
    assert odd.n_tokens * odd.probability / expected == pytest.approx(target, rel=1e-3)
    ids = [r.doc_id for r in M.mixed_documents(df).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in got for _ in range(r.copies))


def test_odd_tables(spark):
    rows = [(1, None, None, None, ""), (None, "a b", "en", "s", ""), (2, "", "en", "t", ""), (3, "a | b", "en", "s", ""),
            (3, "a | b", "en", "s", ""), (4, "#$% &*#", "en", "s", ""), (5, "x " * 100000, "en", "s", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(df).collect()
    assert len(got) == 7 and {r.topic for r in got} == {"prose", "tabular", "symbolic"}
    assert len({r.kept for r in got if r.doc_id == 3}) == 1
    assert M.mixed_documents(df).count() == sum(r.kept for r in got)
    assert M.mix(df.limit(0)).count() == 0 and M.mixed_documents(df.limit(0)).count() == 0


def test_uniform_numbers(spark):
    from pyspark.sql import functions as F

    u = np.array([r[0] for r in spark.range(5000).select(M.uniform(F.col("id"))).collect()])
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", "mine")], "doc_id long, text string, lang string, source string, _source string")
    assert [tuple(r) for r in M.mixed_documents(df).collect()] == [(1, "a", "en", "s", "mine")]
