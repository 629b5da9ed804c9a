import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclake.functions import chunks as K
from doclake.functions.splitting import split_spans
from doclake.operators.chunking import chunk_documents, chunk_spans, renumber

ALPHABET = ["a", "bc", "déf", " ", " ", "\n", "\n\n", "longword" * 3, "😀", "\t"]


def merged_pieces(pieces, size, overlap):
    """Piece by piece, as the contract words it."""
    out, held = [], []
    for piece in pieces:
        if held and sum(map(len, held)) + len(piece) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    return out + (["".join(held)] if held else [])


def brute_force(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    sep = next((s for s in separators if s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        head, *others = text.split(sep)
        pieces = [p for p in [head, *(sep + o for o in others)] if p]
    else:
        pieces = list(text)
    out, run = [], []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        out += merged_pieces(run, size, overlap)
        run = []
        out += brute_force(piece, size, overlap, rest) if rest else [piece]
    return out + merged_pieces(run, size, overlap)


def stripped(text, size, overlap):
    return [c.strip() for c in brute_force(text, size, overlap) if c.strip()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join), st.integers(2, 30), st.integers(0, 12))
def test_spans_equal_brute_force(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert [text[a:b] for a, b in split_spans(text, size, overlap)] == stripped(text, size, overlap)


def test_invariants_on_a_long_text():
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "other ", "x\n", "\n\n", "y" * 50, "é "]) for _ in range(20_000))
    spans = split_spans(text, 400, 80)
    covered = set()
    for (a, b), nxt in zip(spans, spans[1:] + [(len(text), len(text))]):
        assert 0 < b - a <= 400 and a <= nxt[0] and b - nxt[0] <= 80
        covered.update(range(a, b))
    assert all(ch.isspace() for i, ch in enumerate(text) if i not in covered)


def test_long_word_is_cut_by_characters():
    assert split_spans("x" * 10_000, 4000, 800) == [(0, 4000), (3200, 7200), (6400, 10_000)]


def test_rows_and_metadata(spark):
    par = "same paragraph here"
    df = spark.createDataFrame([(1, "\n\n".join([par] * 10)), (2, ""), (3, None)], "doc_id int, content string")
    got = chunk_documents(df, size=50, overlap=25).orderBy("doc_id", "chunk_index").collect()
    text = "\n\n".join([par] * 10)
    assert {r["doc_id"] for r in got} == {1}
    for i, r in enumerate(got):
        assert r["content"] == text[r["char_start"] : r["char_end"]]
        assert r["start_line"] == text[: r["char_start"]].count("\n") + 1
        assert r["end_line"] == text[: r["char_end"]].count("\n") + 1
        assert r["metadata"]["chunk_index"] == i and r["metadata"]["chunk_overlap"] == (25 if i else 0)
        assert r["tokens"] == len(r["content"]) // 4
    starts = [r["char_start"] for r in got]
    assert starts == sorted(set(starts))


def test_first_span_is_the_first_occurrence(one):
    span = one(lambda a, b: K.first_span(a, b), "ab ab", "ab")
    assert (span["char_start"], span["char_end"]) == (0, 2)
    assert one(lambda a, b: K.first_span(a, b), "ab", "zz")["char_start"] is None


@pytest.mark.parametrize("n, size", [(1999, 500), (2000, 1000), (9999, 1000), (10_000, 1500), (50_000, 2000)])
def test_size_heuristic(spark, n, size):
    assert spark.range(1).select(K.optimal_chunk_size(F.lit(n)).alias("s")).first()["s"] == size


def test_size_for_a_number_of_chunks(spark):
    sizes = [spark.range(1).select(K.optimal_chunk_size(F.lit(n), 4).alias("s")).first()["s"] for n in (100, 5555, 99_999)]
    assert sizes == [500, 1300, 2000]


def test_renumber(spark):
    df = spark.createDataFrame(
        [("d", 0, [1.0]), ("d", 1, None), ("d", 2, [1.0]), ("e", 5, [1.0])], "doc_id string, chunk_index int, embedding array<float>"
    )
    assert sorted((r[0], r[1]) for r in renumber(df).select("doc_id", "chunk_index").collect()) == [("d", 0), ("d", 1), ("e", 0)]


def test_bad_sizes():
    with pytest.raises(ValueError):
        chunk_spans("t", 100, 100)
