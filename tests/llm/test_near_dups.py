"""The join against brute force over all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from doclake.llm import near_dups as N

SCHEMA = "doc_id long, text string, rep string, key string, signature string"


def shingles(text, k=5):
    words = [w for w in (x.strip(N.PUNCTUATION) for x in (text or "").lower().split()) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda i: rows[i][0])
                root[y] = x
    return {rows[i][0]: (rows[find(i)][0], links[i], len(sets[i])) for i in range(len(rows))}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = ["", None, " . , ", "one", "One,", "one two three four", "a b c d e", "A b, c d e!"]
    passage = [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 250))]
        texts += [" ".join(base)] + [changed(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(base[:30] + passage))
    hot = [word() for _ in range(300)]
    texts += [changed(rng, hot, 2) for _ in range(450)]  # more than two blocks
    texts += [" ".join(hot)] * 200
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain[k * 15] = "link%d" % k
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_groups_and_links_match_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in N.near_groups(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert [got[i][2] for i in got] == [want[i][2] for i in got]
    found, there = sum(g[1] for g in got.values()), sum(w[1] for w in want.values())
    assert all(got[i][1] <= want[i][1] for i in got)
    assert found >= 0.995 * there
    assert sum(got[i][0] != want[i][0] for i in got) <= 3


def test_shingles_and_signatures():
    texts = ["", None, "a b c", "a b c d e f", "A, b c d e! f a b c d e"]
    found, starts = N.shingle_sets(pa.array(texts))
    assert list(np.diff(starts)) == [len(shingles(t)) for t in texts]
    assert set(found[starts[3] : starts[4]]) < set(found[starts[4] : starts[5]])
    rng = np.random.default_rng(0)
    whole = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    marks = N.minhashes(np.concatenate([whole[:2500], whole[500:]]), np.array([0, 2500, 5000]))
    assert (marks[0] == marks[1]).mean() == pytest.approx(2000 / 3000, abs=0.15)


def test_prefixes_and_recall():
    assert N.prefix_lengths()[-1] == 4 and N.prefix_lengths()[0] == N.DEPTH
    assert N.estimated_recall(0, 0, 0) == 1.0
    assert N.estimated_recall(100, 0, 0) == 1.0
    assert N.estimated_recall(100, 60, 20) < 0.6


def test_a_large_group_costs_no_links_at_the_threshold(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for k in range(2000):
        common = words(44 + k % 9)  # 40 to 48 common shingles of 50 to 58: 0.80 to 0.83
        texts += [" ".join(common + words(5)), " ".join(common + words(5))]
    hot = words(300)
    texts += [changed(rng, hot, 1) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in N.near_groups(df).collect()}
    missed = sum(got[i].n_links == 0 or got[i + 1].class_id != i for i in range(0, 4000, 2))
    assert missed <= 2000 * (1 - N.RECALL)
    assert all(got[i].class_id == 4000 for i in range(4000, 4300))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.v: r.label for r in N.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 103: 100}


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in N.near_groups(df).collect())
    assert got == [(-1, -1, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]
    assert N.near_groups(df.limit(0)).count() == 0


def test_an_id_with_several_texts(spark):
    rows = [(1, "alpha beta"), (1, "gamma delta"), (2, "alpha beta"), (3, "zzz"), (3, "gamma delta"), (1, "alpha beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.drop_near_copies(df).collect())) == [(1, "alpha beta"), (1, "gamma delta"), (3, "zzz")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_groups(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1), (3, 3, 0)]
