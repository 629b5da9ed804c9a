"""Posting blocks against a scan of all texts."""

import random

import pytest

from doclake.operators import blockmax
from doclake.operators import fulltext as FT


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)] + ["common"] * 30
    rows = []
    for i in range(2500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        text += " rare" * (1 + i % 9) if i % 40 == 0 else ""
        rows.append((i, text))
    rows += [(3000 + i, "common common rare word1") for i in range(30)] + [(4000, ""), (4001, None)]
    items = spark.createDataFrame(rows, "doc_id long, text string")
    postings = FT.build_postings(items, "doc_id", "text")
    stats = FT.posting_statistics(postings, items).first()
    return items, blockmax.build_blocks(postings, stats, "doc_id", block_texts=20).cache(), stats


@pytest.mark.parametrize("limit", [1, 5, 40])
@pytest.mark.parametrize("query", ["common", "rare", "common rare", "word1 word2", "word3 common word4", "nowhere", "rare nowhere", "the"])
def test_equals_the_scan(index, query, limit):
    items, blocks, stats = index
    key = lambda df: [(r["doc_id"], round(r["score"], 8)) for r in df.collect()]
    got, share = blockmax.block_search(blocks, stats, query, limit, "doc_id")
    assert key(got) == key(FT.fulltext_hits(items, query, limit, "doc_id", text="text"))
    assert 0 <= share <= 1


def test_blocks_below_the_kth_score_are_left_out(index):
    items, blocks, stats = index
    assert blockmax.block_search(blocks, stats, "rare", 3, "doc_id")[1] < 0.5
    assert blockmax.block_search(blocks, stats, "common rare", 3, "doc_id")[1] < 1


def test_blocks_of_texts_are_those_of_postings(spark):
    """Also across Arrow batches and slices of words; the texts are shuffled, the postings are not."""
    rows = [(i, None if i % 9 == 0 else " ".join(f"w{(i * k) % 23}" for k in range(1, 2 + i % 13))) for i in range(200)]
    items = spark.createDataFrame(rows, "chunk_id long, content string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        postings = FT.build_postings(items).cache()
        stats = FT.text_statistics(items).first()
        assert stats == FT.posting_statistics(postings, items).first()
        built = blockmax.text_blocks(items, stats, block_texts=16)
        shown = lambda df: sorted(
            (r["lexeme"], r["block"], r["n"], round(r["peak"], 12), r["term_bucket"], sorted(map(tuple, r["postings"]))) for r in df.collect()
        )
        plan = built._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression")
        got = shown(built)
        assert len({r[1] for r in got}) > 5
        assert got == shown(blockmax.build_blocks(postings, stats, block_texts=16))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
