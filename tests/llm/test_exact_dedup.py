"""Content sort against a dictionary of normalised texts."""

import hashlib
import random
import re

import pytest

from doclake.llm.exact_dedup import drop_exact_copies, exact_groups

SCHEMA = "doc_id long, text string, lang string, keep_id string, kept string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    out = []
    for row, text in zip(rows, norm):
        mates = [(-len(r[1] or ""), r[0]) for r, t in zip(rows, norm) if t == text and r[0] is not None]
        out.append((row[0], min(mates)[1], len(mates), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture
def rows():
    rng = random.Random(5)
    texts = ["", None, " \t\n", "a b", "ab", "a\x0bb ", "Ab", "été 1", "ét é1", "é" * 5000, "x " * 9000, "😀", " 😀"]
    some = [(i, rng.choice(texts), "en", "x", "y") for i in range(300)]
    hot = [(1000 + i, "same text" + " " * (i % 3), None, None, "y") for i in range(400)]
    return some + hot


def test_groups_match_brute_force(spark, rows):
    # More partitions than the hot group would fill alone, so that its run is cut over tasks.
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_rows_that_stay_keep_all_columns(spark, rows):
    kept = {k for _, k, _, _ in brute(rows)}
    got = drop_exact_copies(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "keep_id", "kept"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a", "en", "", ""), (1, "a", "en", "", ""), (1, "a ", "en", "", ""), (None, "a", "en", "", ""), (2, "b", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_groups(df).collect()
    assert [r.kept for r in got if r.doc_id == 1].count(True) == 1
    assert [(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None] == [(None, 1, True)]
    left = sorted(((r.doc_id or 0, r.text) for r in drop_exact_copies(df).collect()))
    assert left == [(0, "a"), (1, "a "), (2, "b")]


def test_an_id_with_several_texts(spark):
    rows = [(1, "alpha beta"), (1, "gamma delta"), (2, "alpha beta"), (3, "zzz"), (2, "gammadelta "), (3, "zzz")]
    df = spark.createDataFrame([(*r, "en", "a", "b") for r in rows], SCHEMA)
    left = sorted((r.doc_id, r.text) for r in drop_exact_copies(df).collect())
    assert left == [(1, "alpha beta"), (1, "gamma delta"), (3, "zzz")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).count() == 0
    assert drop_exact_copies(df).count() == 0
