"""Postings are grouped in slices of bounded size."""

import pyarrow as pa
import pytest

from doclake.operators import fulltext as FT


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_slices_hold_all_words(monkeypatch, at_once):
    monkeypatch.setattr(FT, "WORDS_AT_ONCE", at_once)
    rows = [[], ["a"], ["a", "b", "a"], [], ["c"] * 7, ["d"], ["e"], []]
    lists = pa.array([["before"], *rows]).slice(1)
    got = list(FT._word_slices(lists))
    assert all(b == c or not sum(map(len, rows[b:c])) for (_, b), (c, _) in zip(got, got[1:]))
    assert [w for a, b in got for r in rows[a:b] for w in r] == [w for r in rows for w in r]
    assert all(sum(map(len, rows[a:b])) <= at_once or len([r for r in rows[a:b] if r]) == 1 for a, b in got)


def test_postings_do_not_depend_on_slices(spark, monkeypatch):
    texts = [(1, "beta beta gamma"), (2, ""), (3, "the"), (4, "gamma delta beta gamma"), (5, None)]
    df = spark.createDataFrame(texts, "chunk_id long, content string").coalesce(1)
    whole = sorted(map(repr, FT.build_postings(df).collect()))
    assert len(whole) == 5 and "positions=[0, 3]" in " ".join(whole)
