import pytest
from pyspark.sql import functions as F

from doclake.functions import code as X
from doclake.operators.snippets import cleaned_content, extract_snippets, link_snippets

FENCE_BASIC = "intro\n```python\nx = call(1)\n```\nmid\n```\ny = call(2)\n```\nend"
FENCE_CPP = "```c++\nint x = 1;\n```\nprose (one)\n```py\nz = call(3)\n```\n"
FENCE_EMPTY = "```\n```\nprose here (two)\n```\ncall(4);\n```\n"
NESTED = "```js\nconst s = `template with (code) inside`;\n```\nafter"


def rows(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_id string, content string")
    return extract_snippets(df).orderBy("ordinal").collect()


def cleaned(spark, text, mode="exact"):
    df = spark.createDataFrame([("d", text)], "doc_id string, content string")
    return cleaned_content(df, mode=mode).first()


def test_offsets_are_those_of_the_whole_match(spark):
    got = rows(spark, FENCE_BASIC)
    assert [(r["content"], r["snippet_type"]) for r in got] == [("x = call(1)", "code_block"), ("y = call(2)", "code_block")]
    for r in got:
        assert FENCE_BASIC[r["start_pos"] : r["end_pos"]] == r["original"]


def test_unknown_opener_shifts_the_pairing(spark):
    assert [r["content"] for r in rows(spark, FENCE_CPP)] == ["prose (one)"]


def test_empty_fence_runs_on(spark):
    assert [r["content"] for r in rows(spark, FENCE_EMPTY)] == ["```\nprose here (two)"]


def test_inline_inside_a_fence(spark):
    got = rows(spark, NESTED)
    assert [r["snippet_type"] for r in got] == ["code_block", "inline_code"]
    exact = cleaned(spark, NESTED)["cleaned_content"]
    assert exact.startswith("[CODE_SNIPPET: size=") and exact.endswith("]\nafter") and exact.count("CODE_SNIPPET") == 1
    compat = cleaned(spark, NESTED, "compat")["cleaned_content"]
    assert compat.startswith("```js") and compat.count("CODE_SNIPPET") == 1


@pytest.mark.parametrize("length, found", [(20, 0), (21, 1)])
def test_inline_length_is_strict(spark, length, found):
    assert len(rows(spark, "see `" + "f(x)".ljust(length, "y") + "` now")) == found


def test_identical_snippets_get_their_own_ids(spark):
    text = "\n".join(f"```\nsame(call)\n```\npart {i}" for i in range(11))
    row = cleaned(spark, text)
    ids = [s["snippet_id"] for s in row["snippets"]]
    assert len(set(ids)) == 11
    at = [row["cleaned_content"].index(i) for i in ids]
    assert at == sorted(at)


def test_code_points_not_bytes(spark):
    text = "é😀 \r\n```\nmain(é)😀;;\n```"
    r = rows(spark, text)[0]
    assert (r["start_pos"], r["end_pos"]) == (text.index("```"), len(text)) and r["char_count"] == 10


def test_placeholders_round_trip(spark):
    row = cleaned(spark, FENCE_BASIC)
    df = spark.createDataFrame([(row["cleaned_content"],)], "t string")
    assert df.select(X.placeholder_ids("t").alias("i")).first()["i"] == [s["snippet_id"] for s in row["snippets"]]


def test_preview(one):
    assert one(X.preview, "# c\n\na = 1  \n// d\nb = 2\nc\nd\ne") == "a = 1 b = 2 c d"
    assert one(X.preview, "# only\n\ncall()") == "# only call()"
    assert one(X.preview, 'say("hi")\nmore') == 'say(\\"hi\\") more'
    assert one(X.preview, "x" * 150 + "\n" + "y" * 150) == "x" * 150 + " " + "y" * 46 + "..."


def test_optional_patterns(spark):
    df = spark.createDataFrame([("d", "<pre><code>run(1);  now</code></pre>")], "doc_id string, content string")
    assert extract_snippets(df).count() == 0
    assert extract_snippets(df, patterns=("html",)).first()["content"] == "run(1);  now"


def test_overlap_link_equals_all_pairs(spark):
    chunks = [(f"c{i}", "d" if i % 3 else "e", i * 700, i * 700 + 1500) for i in range(30)] + [("n", "d", None, None)]
    snippets = [(f"s{i}", "d" if i % 2 else "e", i * 333, i * 333 + (9000 if i == 7 else 50)) for i in range(60)]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, char_start int, char_end int")
    s = spark.createDataFrame(snippets, "snippet_id string, doc_id string, start_pos int, end_pos int")
    got = {r["chunk_id"]: r["code_snippet_ids"] for r in link_snippets(c, s, width=1000).collect()}
    for cid, doc, lo, hi in chunks:
        lo, hi = lo or 0, hi or 0
        want = [sid for sid, sdoc, a, b in snippets if sdoc == doc and lo <= b and hi >= a]
        assert got[cid] == want


def test_language(one):
    assert one(X.guess_language, "import os\ndef f(): pass") == "python"
    assert one(X.guess_language, "let x = 1") == "javascript"
    assert one(X.guess_language, "#!/bin/sh\nls") == "bash"
    assert one(lambda c: F.upper(X.guess_language(c)), "plain") == "TEXT"
