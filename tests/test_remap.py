"""Snippet ids in placeholders and links, and cuts of long texts, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from doclake.functions.code import running_sums
from doclake.functions.patterns import BLOCK, blocks, cut
from doclake.operators import merge as m
from doclake.operators.chunking import chunks_of
from doclake.operators.snippets import cleaned_content


def marked(*ids):
    return "".join(f"text {i} [CODE_SNIPPET: size=1_chars, snippet_id={i}] \n" for i in ids)


def test_remap(spark):
    pairs = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("e", "a", "z")], "doc_id string, old_id string, new_id string")
    rows = [
        ("d", 0, marked("a", "b", "x", "a"), ["b", None, "a"]),
        ("d", 1, "snippet_id=a", []),
        ("d", 2, "snippet_id=", ["a"]),
        ("d", 3, None, ["a", "x"]),
        ("d", 4, "nothing", None),
        ("e", 0, marked("a", "ab"), None),
        ("f", 0, marked("a"), ["a"]),
    ]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, links array<string>")
    got = {(r[0], r[1]): (r["content"], r["links"]) for r in m.remap_snippets(df, pairs, ("doc_id", "chunk_index"), links="links").collect()}
    size = "[CODE_SNIPPET: size=1_chars, snippet_id="
    renamed = lambda s, **to: re.sub(r"snippet_id=(\w+)", lambda x: "snippet_id=" + to.get(x[1], x[1]), s)
    assert size in rows[0][2]
    assert got == {
        ("d", 0): (renamed(rows[0][2], a="b", b="c"), ["c", None, "b"]),
        ("d", 1): ("snippet_id=b", []),
        ("d", 2): ("snippet_id=", ["b"]),
        ("d", 3): (None, ["b", "x"]),
        ("d", 4): ("nothing", None),
        ("e", 0): (renamed(rows[5][2], a="z"), None),
        ("f", 0): (rows[6][2], ["a"]),
    }


def test_many_snippets_in_one_document(spark):
    n = 20_000
    ids = spark.range(n).select(F.lit("d").alias("doc_id"), F.format_string("old%s", "id").alias("old_id"), F.format_string("new%s", "id").alias("new_id"))
    df = spark.createDataFrame([("d", marked(*[f"old{i}" for i in range(n)]))], "doc_id string, content string")
    got = m.remap_snippets(df, ids).first()["content"]
    assert re.findall(r"snippet_id=(\w+)", got) == [f"new{i}" for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 1000])
def test_running_sums(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v"))).first()[0]
    assert got == [sum(values[: i + 1]) for i in range(n)]


def test_cuts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 5 == 0 else "\n" if i % 7 == 0 else chr(97 + i % 26) for i in range(3 * BLOCK + 17))
    edges = [0, 1, 5, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 3 * BLOCK, len(text)]
    spans = [(a, b) for a in edges for b in edges if a <= b]
    df = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int")
    assert [r[0] for r in df.select(cut(blocks("t"), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in spans]
    kind = "array<struct<char_start:int,char_end:int,start_line:int,end_line:int,error:string>>"
    one = spark.createDataFrame([(text, [(a, b, 1, 1, None) for a, b in spans])], f"t string, s {kind}")
    assert [c["content"] for c in one.select(chunks_of("t", "s")).first()[0]] == [text[a:b] for a, b in spans]


def test_a_long_document_with_many_snippets(spark):
    n = 4000
    part = "prose \U0001f600 " * 30 + "\n```python\nvalue = call({})\n```\n"
    text = "".join(part.format(i) for i in range(n))
    df = spark.createDataFrame([("d", text)], "doc_id string, content string")
    row = cleaned_content(df).first()
    assert len(row["snippets"]) == n
    assert all(text[s["start_pos"] : s["end_pos"]] == s["original"] for s in row["snippets"])
    assert len(re.findall(r"\[CODE_SNIPPET: ", row["cleaned_content"])) == n
    assert re.sub(r"\[CODE_SNIPPET:.*?\]", "", row["cleaned_content"]) == re.sub(r"(?s)```.*?\n```", "", text)


def _shuffled_texts(df):
    """Exchanges of a plan that carry texts of chunks."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [p for p in plan.split("\n\n") if p.lstrip().startswith("(") and ") Exchange" in p.split("\n")[0]]
    return sum("content#" in p for p in parts)


def test_chunks_are_shuffled_once(spark):
    """Ids are settled on keys; without broadcasts the texts met three joins, each with a shuffle of its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(3).selectExpr("concat('d', id) doc_id", "concat('n', id) new_doc_id")
        fields = "doc_id string, chunk_index int, context_id string, chunk_id string, content string, code_snippet_ids array<string>"
        rows = [("d0", 0, "c", "x", "see [snippet_id=a] b", ["a", "z"]), ("d1", None, "c", "y", "no", None), ("d9", 0, "c", "w", "no", None), ("d2", 4, "c", "v", None, [])]
        chunks = spark.createDataFrame(rows, fields)
        had = spark.createDataFrame([("n2", 4)], "doc_id string, chunk_index int")
        pairs = spark.createDataFrame([("d0", "a", "A")], "doc_id string, old_id string, new_id string")
        out = m.copy_chunks(ids, chunks, had, "t", pairs)
        assert _shuffled_texts(out) == 1
        got = {(r["doc_id"], r["chunk_index"], r["context_id"], r["content"], tuple(r["code_snippet_ids"] or ())) for r in out.collect()}
        assert got == {("n0", 0, "t", "see [snippet_id=A] b", ("A", "z")), ("n1", None, "t", "no", ())}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_buckets_are_written_without_a_shuffle(spark, tmp_path):
    from doclake.sources.corpus import Corpus

    seen = []
    for buckets in (2, 64):
        corpus = Corpus(spark, str(tmp_path / str(buckets)), buckets=buckets)
        corpus.register(spark.createDataFrame([("a",)], "name string"))
        cid = corpus.context_id("a")
        rows = spark.range(0, 40, 1, 4).selectExpr(f"'{cid}' context_id", "cast(id as string) doc_id", "concat('u', id) url", "'text' content")
        corpus.append("documents", rows)
        assert corpus.read("documents", cid).count() == 40
        seen.append(len(list((tmp_path / str(buckets) / "documents").rglob("*.parquet"))))
    # Four tasks with rows of both buckets each, as they were read.
    assert seen[0] == 8 and seen[1] <= 40
