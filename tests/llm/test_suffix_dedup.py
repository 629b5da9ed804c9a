"""Removal of repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from doclake.llm import suffix_dedup
from doclake.llm.suffix_dedup import WINDOW, merged, remove_repeats, repeat_digest

SCHEMA = "doc_id long, text string, key string, pid long, body string, start int"


def brute(rows):
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, out = set(), {}
    for doc_id, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - WINDOW + 1):
            window = data[k : k + WINDOW]
            if window in seen:
                gone[k : k + WINDOW] = b"\1" * WINDOW
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id, text] = (doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r[0], r[1] or ""] for r in rows), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, "b", 2) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in repeat_digest(df).collect()), key=repr)
    want = brute(rows)
    assert got == want
    return want


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "x", "longerword", "of", "the"]) + str(rng.randrange(40)) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [words(rng, 30) for _ in range(6)] + ["z" * 260, "ab" * 200, "abc" * 90]
    rows = []
    for i in range(160):
        parts = [words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        text = " ".join(parts)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            rows.append((1000 + i, text[:at] + "!" + text[at + 1 :]))
        rows.append((i, text))
    rows += [(2000 + i, rows[i % 5][1]) for i in range(60)]
    rows += [(None, passages[0]), (3000, None), (3001, ""), (3002, "short"), (3003, "y" * 100), (3004, "y" * 99), (3005, "y" * 100)]
    rows += [(3006, "\x00" * 150 + "q"), (3007, "\x00" * 150), (3008, words(rng, 4000) * 2), (5, rows[5][1])]
    rng.shuffle(rows)
    want = check(spark, rows)
    assert sum(w[2] > 0 for w in want) > 100


def test_edges_of_windows(spark):
    """Shared strings of 99, 100 and 101 bytes, between different neighbours."""
    rng = random.Random(1)
    rows = []
    for n in (99, 100, 101, 130):
        shared = "".join(rng.choice("abcdefgh") for _ in range(n))
        for k in range(4):
            left, right = ("".join(rng.choice("ijklmnop") for _ in range(rng.randint(0, 150))) for _ in range(2))
            rows.append((len(rows), left + shared + right))
    check(spark, rows)


def test_shared_ends_shorter_than_a_window(spark):
    """Texts that end alike on less than a window share no window, though the last of them are followed by nothing."""
    rng = random.Random(3)
    rows = []
    for n in (95, 96, 97, 98, 99, 100):
        for _ in range(6):
            shared = "".join(rng.choice("abcdefgh") for _ in range(n))
            rows += [(len(rows) + k, "".join(rng.choice("klmnop") for _ in range(59)) + "ij"[k] + shared) for k in range(2)]
    want = check(spark, rows)
    assert {w[1] for w in want if w[2]} == {160}


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 500)
    rng = random.Random(4)
    line = "the same long line of a template, number {} of the day, and then the rest of it as it always stands here, to the end."
    rows = [(i, words(rng, 5) + line.format(rng.randrange(9)) + words(rng, rng.randint(0, 8))) for i in range(150)]
    check(spark, rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("level", [0, 1, 2])
def test_merge_orders_suffixes(level):
    """Positions of one text, ranked on the next level, come in the order of their suffixes."""
    rng = np.random.default_rng(level)
    text = rng.integers(97, 100, 400, dtype=np.uint8)
    padded = np.append(text, np.zeros(200, np.uint8))
    at = np.flatnonzero(suffix_dedup.on_level(level, np.arange(400)))
    rank = {int(p): k + 1 for k, p in enumerate(sorted(np.flatnonzero(suffix_dedup.on_level(level + 1, np.arange(400))), key=lambda p: bytes(text[p:])))}
    step = 3**level
    size = -(-2 * step // 8)
    grid = np.zeros((len(at), 8 * size), np.uint8)
    grid[:, : 2 * step] = np.lib.stride_tricks.sliding_window_view(padded, 2 * step)[at]
    kinds = suffix_dedup.kind(level, at)
    one = np.array([rank.get(int(p) + step, 0) for p in at])
    two = np.array([rank.get(int(p) + 2 * step, 0) for p in at])
    own = np.array([rank.get(int(p), 0) for p in at])
    order = merged(level, kinds, list(grid.view(">u8").astype(np.uint64).T), np.where(kinds == 0, one, own), np.where(kinds == 1, one, two))
    assert [int(p) for p in at[order]] == sorted(map(int, at), key=lambda p: bytes(text[p:]))


def passages_in_texts(n):
    rng = random.Random(8)
    shared = [words(rng, 25) for _ in range(12)]
    return [(i, " ".join([words(rng, 30), rng.choice(shared), words(rng, 30), rng.choice(shared)])) for i in range(n)]


def test_no_row_for_each_anchor_or_phrase(spark, monkeypatch):
    """Spark handles packed rows: no table has more rows than there are texts and stretches."""
    counts = {}
    write = suffix_dedup._Tables.write

    def counting(self, name, df):
        out = write(self, name, df)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup._Tables, "write", counting)
    want = check(spark, passages_in_texts(300))
    assert sum(w[2] > 0 for w in want) > 250
    assert max(n for name, n in counts.items() if name != "stretches") <= 300


def test_many_blocks(spark, monkeypatch):
    """Blocks of few texts, several in a task, with copies, empty texts and one text longer than a block."""
    for name, n in (("BLOCK_BYTES", 1500), ("TASK_BYTES", 9000), ("MEETING", 400)):
        monkeypatch.setattr(suffix_dedup, name, n)
    rows = passages_in_texts(60)
    rows += [rows[7]] * 3 + [(None, rows[3][1])] * 2 + [(100 + i, None) for i in range(5)] + [(200, rows[5][1] * 30), (201, "")]
    random.Random(2).shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("gram", [36, 80, 96])
def test_anchors_across_slices(gram):
    """Every wanted window holds an anchor; equal windows hold it at the same place, also where slices meet."""
    rng = np.random.default_rng(gram)
    n = 3 * suffix_dedup.SLICE
    data = rng.integers(97, 123, n, dtype=np.uint8)
    data[n - 40_000 :] = data[100:40_100]
    wanted = np.ones(n - WINDOW + 1, bool)
    wanted[50_000:50_500] = False
    places, grams = suffix_dedup.anchors(data, wanted, gram)
    assert (np.diff(places) > 0).all()
    at = np.searchsorted(places, np.flatnonzero(wanted))
    assert (places[at] <= np.flatnonzero(wanted) + WINDOW - gram).all()
    first, again = places[(places >= 300) & (places < 39_700)], places[places >= n - 39_800]
    assert set((again - (n - 40_000) + 100).tolist()) >= set(first.tolist())


def test_anchors_are_dealt_evenly():
    data = np.random.default_rng(1).integers(97, 123, 400_000, dtype=np.uint8)
    places, grams = suffix_dedup.anchors(data, np.ones(len(data) - WINDOW + 1, bool))
    sizes = [len(row[3]) // 8 for row in suffix_dedup._dealt(0, 50, places, grams)]
    assert len(sizes) == 50 and max(sizes) < 1.5 * len(grams) / 50
