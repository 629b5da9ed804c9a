"""What ingest spares: a regular expression over every sign, and texts outside of the backticks."""

import random

import pytest
from pyspark.sql import functions as F

from doclake.functions import code
from doclake.functions.patterns import SPACE_CHARS
from doclake.functions.text import prepare_text
from doclake.functions.vectors import BatchEmbedder, embed


def texts(n):
    rng = random.Random(5)
    signs = ["a", "é", "😀", ".", " ", "  ", *SPACE_CHARS]
    return ["", " 　", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def test_white_space_is_collapsed_in_the_embedders_task(spark):
    def call(found):
        return [[float(sum(map(ord, t))), float(len(t)), float(t.count(" "))] for t in found]

    df = spark.createDataFrame([(t,) for t in texts(200)], "content string").coalesce(2)
    prepared = df.withColumn("v", BatchEmbedder(call, 3, 7).vectors(prepare_text("content", None)))
    given = df.withColumn("v", embed("content", BatchEmbedder(call, 3, 7)))
    assert given.collect() == prepared.collect()
    assert "regexp_replace" not in given._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("head, tail", [("", ""), ("é😀 (x)\n" * 700, ""), ("", " ü();\n" * 900), ("日;" * 5000, "\n😀" * 5000)])
def test_only_text_between_backticks_is_matched(spark, head, tail):
    body = "```py\nx = load(1)\nprint(x)\n```\ncall `fetch_rows(table=1, limit=10)` or `short` ``` open(1)"
    df = spark.createDataFrame([(head + body + tail,)], "t string")
    found = df.select(code.snippets("t").alias("s"), code.matches("t", code.FENCE, 2, "sm").alias("m")).first()
    text = head + body + tail
    assert [text[s["start_pos"] : s["end_pos"]] for s in found["s"]] == [s["original"] for s in found["s"]]
    assert [s["start_pos"] for s in found["s"] if s["snippet_type"] == "code_block"] == [m["start_pos"] for m in found["m"]]
    assert len(found["s"]) == 2
    plan = df.select(code.snippets("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan
