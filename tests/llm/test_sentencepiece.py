"""Encoding against the model's own library, decoding as a round trip, the relational lattice against a plain Viterbi."""

import random

import pytest

from doclake.llm import sentencepiece_codec as C


@pytest.fixture(scope="module")
def table():
    return C.load_pieces()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    parts = ["the", "thion", "é", "ß", "\n", "  ", " ", "▁", "😀", "漢字", "\x00", "<s>", "<0x0A>", "12345", "\t", "\r\n", "internationalisation"]
    out = ["", None, " ", "  ", "▁", "a", "\n", "x" * 3000, " " * 700 + "a", "no" * 900, "é" * 50, "ab " * 9000]
    for _ in range(400):
        out.append("".join(rng.choice(parts) for _ in range(rng.randint(1, 20))))
        out.append(" ".join("".join(rng.choice("abcdefghinorstuäé") for _ in range(rng.randint(1, 14))) for _ in range(30)))
    return out


def test_ids_equal_the_library(spark, table, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = C.encode(df, table)
    rows = {r.doc_id: r for r in got.collect()}
    for i, text in enumerate(texts):
        assert list(rows[i].ids) == model.encode(text or ""), repr(text)
        assert rows[i].n_pieces == len(rows[i].ids) and rows[i].round_trip
    back = {r.doc_id: r.text for r in C.decode(got, table).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_documents_equal_the_library(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in C.encode(docs, table).collect():
        assert list(r.ids) == model.encode(text[r.doc_id])


def viterbi(word, pieces, longest):
    best = [(0.0, ())] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(max(0, e - longest), e):
            known = pieces.get(word[b:e], (-1, -1e9) if e == b + 1 else None)
            if known and (best[e] is None or best[b][0] + known[1] > best[e][0]):
                best[e] = (best[b][0] + known[1], best[b][1] + (known[0],))
    return list(best[-1][1])


def test_relational_lattice(spark, table):
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("abcdehinorst漢") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    frame = C.piece_frame(spark, table)
    pieces = {r.piece: (r.id, r.score) for r in frame.collect()}
    df = spark.createDataFrame([(w,) for w in words + words[:50] + ["", None]], "word string")
    got = {r.word: list(r.ids) for r in C.viterbi_words(df, frame, 16).collect()}
    assert got == {w: viterbi(w, pieces, 16) for w in words}


def test_empty(spark, table):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.encode(df, table).count() == 0
    assert C.decode(C.encode(df, table), table).count() == 0
