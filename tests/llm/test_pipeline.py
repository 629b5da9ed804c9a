"""The pipeline's stages, each against brute force on its own input, and what run() returns."""

import sentencepiece

import corpus_pipeline as P
from doclake.llm import mixing, near_dups, sentencepiece_codec, toxicity
from doclake.llm.common import stored

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from test_near_dups import brute as brute_near  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns = docs.columns
    outputs, before = [], docs
    for name, stage in P.STAGES:
        before = stored(stage(spark, before, FOLDER), name)
        outputs.append(before)
    clean, unique, far, mixed, encoded = outputs
    assert all(df.columns == columns for df in outputs[:-1])
    verdict = rows_of(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert set(rows_of(clean)) == {i for i, r in verdict.items() if r.predicted == 0}
    texts = {}
    for i, r in sorted(rows_of(clean).items()):
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        texts.setdefault(key, []).append((-len(r.text), i))
    assert set(rows_of(unique)) == {min(v)[1] for v in texts.values()}
    near = brute_near([(r.doc_id, r.text) for r in unique.collect()])
    assert set(rows_of(far)) == {i for i, (c, _, _) in near.items() if c == i}
    assert set(rows_of(mixed)) == {r.doc_id for r in mixing.mix(far).where("kept").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    source, got = rows_of(mixed), rows_of(encoded)
    assert set(got) == set(source)
    assert all(list(got[i].ids) == model.encode(source[i].text) for i in got)
    assert all(r.round_trip for r in got.values())
    final = rows_of(P.run(spark, FOLDER))
    assert {i: list(r.ids) for i, r in final.items()} == {i: list(r.ids) for i, r in got.items()}


def test_near_copies_keep_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z")], "doc_id long, text string, _first string")
    got = near_dups.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r["_first"]) for r in got.collect()) == [(0, "z"), (1, "y")]


def test_run_over_odd_documents(spark, tmp_path):
    """Repeated ids with different texts, null sources and texts, an empty table: run() keeps every distinct clean text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"w{k}{i}" for i in range(30))
    rows = [(1, words("a"), "en", None, 3), (1, words("b"), "en", "s", 3), (2, words("a"), None, "s", 3), (3, None, "en", "s", 0), (None, words("c"), "en", "s", 1)]
    rows += [(10 + i, words(f"x{i}q"), "en", "s", 3) for i in range(20)]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, content in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(content, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    far = P.without_near_copies(spark, stored(P.without_copies(spark, docs, ""), "odd"), "")
    assert {r.text for r in far.collect()} == {r[1] for r in rows}
    got = P.run(spark, f"{tmp_path}/odd").collect()
    assert 0 < len(got) and all(r.round_trip for r in got)
    assert P.run(spark, f"{tmp_path}/empty").collect() == []
