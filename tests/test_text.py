import pytest

from doclake.functions import text as T
from doclake.functions.stemming import stem
from doclake.functions.summaries import BatchSummarizer, LeadSummarizer, summary_only, title_and_summary
from doclake.functions.vectors import BatchEmbedder, HashEmbedder, embed

# Examples from the paper and its sample vocabulary.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope",
    "formality": "formal", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "replacement": "replac", "adjustment": "adjust", "adoption": "adopt", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controlling": "control", "rolling": "roll", "generalizations": "gener",
    "oscillators": "oscil",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


def test_lexemes(one):
    text = "The quick_brown foxes, étés & 3 runs. The end"
    assert one(T.lexemes, text) == ["quick_brown", "foxes", "étés", "3", "runs", "end"]
    assert one(lambda c: T.lexemes(c, stemming=True), text) == ["quick_brown", "fox", "étés", "3", "run", "end"]
    assert T.query_lexemes("The Runs runs", stemming=True) == ["run"]


def test_stems_by_batch_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "runs"), (2, None), (3, ""), (4, "cats ties")], "i int, t string").coalesce(1)
    got = {r["i"]: r["l"] for r in df.select("i", T.lexemes("t", stemming=True).alias("l")).collect()}
    assert got == {1: ["run"], 2: [], 3: [], 4: ["cat", "ti"]}


def test_reply(one):
    r = one(T.parse_title_summary, "Title: abc\nTitle:  A longer title \nSummary: too short\nSummary: " + "s" * 20)
    assert (r["title"], r["summary"]) == ("A longer title", "s" * 20)
    assert one(T.parse_title_summary, "Title: Once good\nTitle: abcd")["title"] is None


def test_highlight_and_relevance(one):
    assert one(lambda c: T.highlight(c, "C++ to", "<", ">"), "use c++ to") == "use <c++> to"
    assert one(lambda c: T.relevance(c, ["API", "zz"]), "an api") == 0.5
    assert one(lambda c: T.relevance(c, None), "x") == 1.0
    assert one(T.auto_keywords, "http://rapid.io") == T.DOC_KEYWORDS
    assert one(T.auto_keywords, "http://x.io") is None


def test_prepare(one):
    assert one(lambda c: T.prepare_text(c, 5), " a \n b  cdef") == "a b c"


def test_failed_batch_stays_with_its_rows(spark):
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, "bad" if i == 3 else "x" * i) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", embed("t", BatchEmbedder(call, 2, batch=2)).alias("v")).collect()}
    assert {i for i, v in got.items() if v is None} == {0, 3, 4}  # empty text, and the batch of the bad one
    assert all(got[i][0] == i for i in (1, 2, 5, 6, 7))


def test_hash_embedder_is_deterministic(spark):
    e = HashEmbedder(64)
    df = spark.createDataFrame([("some words here",), ("some words here",), ("other",)], "t string").repartition(3)
    vectors = [tuple(r["v"]) for r in df.select(embed("t", e).alias("v")).collect()]
    assert len(set(vectors)) == 2 and tuple(e.query("some words here")) in vectors


def test_summaries(one):
    long = "First one. Second two! Third three? Fourth four. " * 20
    got = one(lambda c: title_and_summary(c, LeadSummarizer()), long)
    assert got["title"] == "First one. Second two! Third three? Fourth four."
    assert got["summary"] == "First one. Second two! Third three?" and got["summary_model"] == "lead-sentences"
    assert one(lambda c: title_and_summary(c, LeadSummarizer()), "short")["title"] is None
    assert one(lambda c: summary_only(c, LeadSummarizer()), "x" * 600) is None
    fixed = BatchSummarizer("m", lambda ts: ["Title: Some title\nSummary: tiny"] * len(ts))
    got = one(lambda c: title_and_summary(c, fixed), "y" * 60)
    assert (got["title"], got["summary"], got["summary_model"]) == ("Some title", None, None)
