import os
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from doclake import session
from doclake.functions.vectors import HashEmbedder
from doclake.operators import documents as D
from doclake.operators import ledger as L
from doclake.operators import merge as M
from doclake.plans.ingest import store_processed
from doclake.plans.merging import merge_contexts
from doclake.plans.search import search, search_code
from doclake.sources import bundle
from doclake.sources.corpus import Corpus
from doclake.streaming.ingest import ingest_stream

NOW = datetime(2024, 1, 1)
TEXT, CODE = HashEmbedder(64), HashEmbedder(32)
GUIDE = "# Guide\nabout joins and tables\n```python\ndef join(a, b):\n    return a\n```\nuse `join_tables(left, right)` well. " + "more words on tables. " * 250
TABLES = ("documents", "raw_documents", "chunks", "code_snippets")


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, title string, content string")


def put(corpus, name, df):
    return store_processed(corpus, name, df, embedder=TEXT, snippet_embedder=CODE, now=NOW)


def counts(corpus, name):
    cid = corpus.context_id(name)
    return tuple(corpus.read(t, cid).count() for t in TABLES)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("base") / "corpus")
    c = Corpus(spark, path, buckets=2)
    c.register(spark.createDataFrame([("a",), ("b",)], "name string"), NOW)
    put(c, "a", pages(spark, ("http://x/1/", "One", GUIDE), ("http://x/2", "Two", "a page about windows " * 5)))
    return path


@pytest.fixture
def corpus(spark, stored, tmp_path):
    shutil.copytree(stored, tmp_path / "corpus")
    return Corpus(spark, str(tmp_path / "corpus"), buckets=2)


def test_store_and_repeat(corpus, spark):
    before = counts(corpus, "a")
    assert before[0] == before[1] == 2 and before[3] == 2
    out = put(corpus, "a", pages(spark, ("http://x/1", "New", "short text only"), (None, "bad", "x"), ("http://x/3", "e", " ")))
    summary = L.run_summary(out).first()
    assert (summary["documents_processed"], summary["documents_failed"], summary["total_chunks"]) == (1, 2, 1)
    assert {r["error"] for r in L.failed_documents(out).collect()} == {"document has no url", "document has no content"}
    # The old chunks and snippets of the document are gone, the other document is untouched.
    assert counts(corpus, "a") == (2, 2, 2, 0)
    assert {r["title"] for r in corpus.read("documents").collect()} == {"New", "Two"}


def test_snippet_links_and_raw_text(corpus):
    cid = corpus.context_id("a")
    linked = {i for r in corpus.read("chunks", cid).collect() for i in r["code_snippet_ids"]}
    assert linked == {r["snippet_id"] for r in corpus.read("code_snippets", cid).collect()}
    doc = corpus.read("documents", cid).where("title = 'One'")
    raw = D.get_documents(corpus.read("documents"), doc.select("doc_id"), corpus.read("raw_documents"), cid).first()
    assert raw["content"] == GUIDE and "CODE_SNIPPET" in doc.first()["content"]
    assert doc.first()["chunk_count"] == corpus.read("chunks", cid).join(doc, "doc_id", "left_semi").count()


def test_source_type_and_id_survive(corpus, spark):
    old = corpus.read("documents").where("title = 'Two'").first()
    changed = [(old["context_id"], "http://x/2///", "Two b", "c", None, NOW, "file")]
    corpus.upsert_documents(
        spark.createDataFrame(changed, "context_id string, url string, title string, content string, metadata map<string,string>, indexed_at timestamp, source_type string")
    )
    new = corpus.read("documents").where("title = 'Two b'").first()
    assert (new["doc_id"], new["source_type"], new["url"]) == (old["doc_id"], "url", "http://x/2")
    assert corpus.read("documents").count() == 2


def test_failed_vectors_renumber(spark, tmp_path):
    from doclake.functions.vectors import BatchEmbedder

    c = Corpus(spark, str(tmp_path / "c"), 2)
    c.register(spark.createDataFrame([("a",)], "name string"), NOW)

    def call(texts):
        if texts[0].startswith("# Guide"):
            raise RuntimeError
        return [[1.0, 2.0]] * len(texts)

    store_processed(c, "a", pages(spark, ("u", "t", GUIDE)), embedder=BatchEmbedder(call, 2, 1), snippet_embedder=CODE, now=NOW)
    rows = c.read("chunks").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and not rows[0]["content"].startswith("# Guide")
    assert c.read("documents").first()["chunk_count"] == len(rows)


def test_search(corpus):
    for mode in ("vector", "fulltext", "hybrid"):
        got = search(corpus, "a", "tables joins", mode, 3, embedder=TEXT).collect()
        assert "http://x/1" in {r["url"] for r in got}
        assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
        assert all(r["metadata"]["document"]["title"] == r["title"] for r in got)
    assert [r["url"] for r in search(corpus, "a", "tables joins", "fulltext", 1, embedder=TEXT).collect()] == ["http://x/1"]
    short = search(corpus, "a", "guide joins", "fulltext", 3, "compact", embedder=TEXT).collect()
    assert short[0]["code_snippets_count"] == 1 and short[0]["code_snippet_ids"][0]["lines"] == 2
    code = search_code(corpus, "a", "join return", "hybrid", 3, "compact", embedder=CODE).first()
    assert code["content"].startswith("def join") and code["line_count"] == 2
    with pytest.raises(ValueError):
        search(corpus, "nowhere", "x")


def test_merge_twice(corpus, spark):
    put(corpus, "b", pages(spark, ("http://x/2/", "Other two", "different words here"), ("http://x/9", "Nine", "ninth page text")))
    first = merge_contexts(corpus, ["a", "b"], "both", now=NOW).first()
    assert first["documents_merged"] == 3
    state = counts(corpus, "both")
    again = merge_contexts(corpus, ["a", "b"], "both", now=NOW).first()
    assert again["chunks_merged"] == again["code_snippets_merged"] == 0 and counts(corpus, "both") == state
    both = merge_contexts(corpus, ["a", "b"], "common", "intersection", now=NOW).first()
    assert both["documents_merged"] == 1
    assert corpus.list_contexts("both").first()["description"] == "Merged from a, b"
    # Placeholders and links name the copied snippets.
    cid = corpus.context_id("both")
    own = {r["snippet_id"] for r in corpus.read("code_snippets", cid).collect()}
    assert {i for r in corpus.read("chunks", cid).collect() for i in r["code_snippet_ids"]} == own
    text = corpus.read("documents", cid).where("title = 'One'").first()["content"]
    assert all(i in text for i in own)
    with pytest.raises(ValueError):
        merge_contexts(corpus, ["a", "none"], "x")


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_bundle(corpus, spark, tmp_path, form):
    path = str(tmp_path / "bundle")
    manifest = bundle.export_context(corpus, "a", path, form, NOW).first()
    assert (manifest["total_documents"], manifest["total_code_snippets"], manifest["schema_version"]) == (2, 2, "1.0")
    with pytest.raises(ValueError):
        bundle.import_context(corpus, path, form=form)
    before = counts(corpus, "a")
    vectors = sorted(tuple(r["embedding"]) for r in corpus.read("chunks").collect())
    bundle.import_context(corpus, path, overwrite=True, form=form, now=NOW)
    assert counts(corpus, "a") == before
    assert sorted(tuple(r["embedding"]) for r in corpus.read("chunks").collect()) == vectors
    bundle.import_context(corpus, path, form=form, name="copy", now=NOW)
    assert counts(corpus, "copy") == before and counts(corpus, "a") == before


def test_orphans_are_left_out(corpus):
    cid = corpus.context_id("a")
    tables = {t: corpus.read(t, cid) for t in TABLES}
    tables["documents"] = tables["documents"].where("title = 'Two'")
    moved = bundle.remap_bundle(tables, "new")
    assert moved["code_snippets"].count() == 0 and moved["chunks"].count() == 1


def test_deletes(corpus, spark):
    ids = corpus.read("documents").where("title = 'One'").select("doc_id")
    assert corpus.delete_documents("a", ids) == 1
    assert counts(corpus, "a") == (1, 1, 1, 0)
    corpus.delete_context("a")
    assert [r["name"] for r in corpus.list_contexts().collect()] == ["b"]
    assert all(corpus.read(t).count() == 0 for t in TABLES)


def test_listings_and_look_ups_read_no_text(corpus, spark):
    """Sizes come from their own columns; the texts of documents are in no scan."""
    cid = corpus.context_id("a")
    texts = {r["doc_id"]: r["content"] for r in corpus.read("documents", cid).collect()}
    listed = corpus.list_contexts("a")
    assert listed.first()["size_mb"] == round(sum(len(t.encode()) for t in texts.values()) / 2**20, 6)
    chunks, snippets = (corpus.read(t, cid).drop("content") for t in ("chunks", "code_snippets"))
    detailed = D.chunk_details(chunks, corpus.read("documents", cid), snippets.withColumn("content", F.lit("")), chunks.select("chunk_id"))
    assert all(r["parent_page_size"] == len(texts[r["doc_id"]]) for r in detailed.collect())
    for frame in (listed, corpus.statistics(), detailed):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
        assert scans and not any("content:string" in line or "content#" in line for line in scans)


def test_names(corpus, spark):
    for bad in ("a", "", "x" * 101):
        with pytest.raises(ValueError):
            corpus.register(spark.createDataFrame([(bad,)], "name string"))
    stats = {r["name"]: (r["documents"], r["code_snippets"]) for r in corpus.statistics().collect()}
    assert stats == {"a": (2, 2), "b": (0, 0)}
    corpus.refresh_counts("a")
    assert corpus.read("documents").agg(F.sum("chunk_count")).first()[0] == corpus.read("chunks").count()


def test_intersection_of_three(spark):
    rows = [("1", "a", "u"), ("2", "a", "v"), ("3", "a", None), ("4", "b", "u"), ("5", "b", "v"), ("6", "c", "u"), ("7", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, context_id string, url string")
    assert [r["doc_id"] for r in M.merge_intersection(docs, ["a", "b", "c"]).collect()] == ["1"]
    assert M.merge_intersection(docs, ["a"]).count() == 3
    assert M.collect_documents(docs, ["c", "a"]).count() == 3


def test_stream_of_pages(corpus, spark, tmp_path):
    body = "<html><title>T{0}</title><body><p>" + "words about tables " * 20 + "{0}</p></body></html>"
    rows = [(f"http://p/{i}", body.format(i)) for i in range(6)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "url string, html string").repartition(2).write.parquet(folder)
    source = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 1).parquet(folder)
    options = {"embedder": TEXT, "snippet_embedder": CODE, "now": NOW}
    ingest_stream(corpus, "b", source, str(tmp_path / "check"), **options).awaitTermination()
    assert counts(corpus, "b") == (6, 6, 6, 0)
    # A second run over the same folder from scratch changes nothing.
    ingest_stream(corpus, "b", source, str(tmp_path / "check2"), **options).awaitTermination()
    assert counts(corpus, "b") == (6, 6, 6, 0)


def key(rows):
    return [(r["chunk_id"], round(r["score"], 6)) for r in rows]


def test_indexes(corpus, spark):
    """Searches through indexes equal the scan, also when the context has changed since."""
    from doclake.plans.indexes import index_text, index_vectors, indexed_search, text_hits, vector_index
    from doclake.plans.search import search_batch

    queries = ("tables", "window join")
    modes = ("vector", "fulltext", "hybrid")
    cid = corpus.context_id("a")

    def answers():
        return {(q, m): key(search(corpus, "a", q, m, 3, embedder=TEXT).collect()) for q in queries for m in modes}

    before = answers()
    index_text(corpus, "a", buckets=8)
    index_vectors(corpus, "a", cells=2)
    assert text_hits(corpus, cid, "tables", 3) is not None and vector_index(corpus, cid) is not None
    assert answers() == before
    near = indexed_search(corpus, "a", "tables", TEXT.query("tables"), limit=3).collect()
    assert key(near) == before["tables", "hybrid"]
    asked = spark.createDataFrame([(k, TEXT.query(q)) for k, q in enumerate(queries)], "query_id long, embedding array<float>")
    batch = {k: [] for k in range(len(queries))}
    for r in search_batch(corpus, "a", asked, 3).orderBy("query_id", "rank").collect():
        batch[r["query_id"]].append((r["chunk_id"], round(r["score"], 6)))
    assert [batch[k] for k in range(len(queries))] == [before[q, "vector"] for q in queries]
    # A changed and a new document: the postings no longer fit, the cells are read beside what is newer.
    put(corpus, "a", pages(spark, ("http://x/2", "Two", "other words on tables " * 5), ("http://x/5", "Five", "a window to join")))
    assert text_hits(corpus, cid, "tables", 3) is None
    through, also, without = vector_index(corpus, cid)
    assert also.count() == 2 and without.count() == 1
    indexed = answers()
    shutil.rmtree(f"{corpus.path}/_indexes")
    assert indexed == answers() and indexed != before
    with pytest.raises(ValueError):
        indexed_search(corpus, "a", "tables")


UPSERT = "context_id string, url string, title string, content string, metadata map<string,string>, indexed_at timestamp, source_type string"


def twenty(spark, path):
    """A corpus of twenty documents in four buckets, and the same documents with ten new titles."""
    c = Corpus(spark, str(path), buckets=4)
    rows = [("ctx", f"http://x/{i}", f"t{i}", "text", None, NOW, "url") for i in range(20)]
    c.upsert_documents(spark.createDataFrame(rows, UPSERT))
    changed = [(*r[:2], "new", *r[3:]) for r in rows[:10]]
    return c, rows, changed


def titles(corpus):
    return {(r["url"], r["title"]) for r in corpus.read("documents").collect()}


@pytest.mark.parametrize("step", range(4))
def test_interrupted_upsert_is_all_or_nothing(spark, tmp_path, monkeypatch, step):
    c, rows, changed = twenty(spark, tmp_path / "c")
    before, after = titles(c), {(r[1], r[2]) for r in changed + rows[10:]}
    calls = 0

    def failing(real, late):
        def run(self, *args):
            nonlocal calls
            calls += 1
            if calls == step + 1 and not late:
                raise OSError("interrupted")
            out = real(self, *args)
            if calls == step + 1:
                raise OSError("interrupted")
            return out

        return run

    for late in (False, True):
        calls = 0
        with monkeypatch.context() as m:
            for name in ("_replace", "append", "_commit"):
                m.setattr(Corpus, name, failing(getattr(Corpus, name), late))
            try:
                c.upsert_documents(spark.createDataFrame(changed, UPSERT))
            except OSError:
                pass
        assert titles(Corpus(spark, c.path, buckets=4)) == (after if step == 3 or (step == 2 and late) else before)
    c.upsert_documents(spark.createDataFrame(changed, UPSERT))
    assert titles(c) == after


def test_a_reader_between_the_steps_of_a_write(spark, tmp_path, monkeypatch):
    """Readers see the old or the new state whole, write nothing, and frames planned before go on reading the old one."""
    c, rows, changed = twenty(spark, tmp_path / "c")
    before, after = titles(c), {(r[1], r[2]) for r in changed + rows[10:]}
    other, planned, seen = Corpus(spark, c.path, buckets=4), c.read("documents"), []

    def watched(real):
        def run(self, *args):
            seen.append(titles(other))
            real(self, *args)
            seen.append(titles(other))

        return run

    with monkeypatch.context() as m:
        for name in ("_replace", "append", "_commit"):
            m.setattr(Corpus, name, watched(getattr(Corpus, name)))
        c.upsert_documents(spark.createDataFrame(changed, UPSERT))
    assert seen[-1] == after and all(s == before for s in seen[:-1])
    assert {(r["url"], r["title"]) for r in planned.collect()} == before and titles(other) == after


def test_small_upserts_write_little(spark, tmp_path):
    def rows_written(corpus):
        return spark.read.parquet(corpus.location("documents")).count()

    c, rows, changed = twenty(spark, tmp_path / "c")
    for k in range(3):
        c.upsert_documents(spark.createDataFrame([(*changed[0][:2], f"v{k}", *changed[0][3:])], UPSERT))
    assert rows_written(c) == 23 and len(titles(c)) == 20
    c.register(spark.createDataFrame([("named",)], "name string"), NOW)
    cid = c.context_id("named")
    c.upsert_documents(spark.createDataFrame([(cid, *r[1:]) for r in rows], UPSERT))
    c.upsert_documents(spark.createDataFrame([(cid, *r[1:]) for r in changed], UPSERT))
    state = titles(c)
    c.compact("named")
    assert titles(c) == state and c.context_id("named") == cid
    live = c.read("documents", cid, [c.read("documents", cid).first()["doc_id"]])
    assert live.count() == 1
    assert "bucket#" in live._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_is_left_in_the_scratch_folder(corpus, spark):
    root = os.path.dirname(session.shared_dir(spark, "x").removeprefix("file:"))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    put(corpus, "b", pages(spark, ("http://x/2/", "Other two", "different words here")))
    merge_contexts(corpus, ["a", "b"], "both", now=NOW)
    kinds = [name.split("-")[:-1] for name in set(os.listdir(root)) - before]
    kinds = [k for k in kinds if k[0] in ("ingest", "merge", "upsert", "import")]
    assert kinds == [["ingest", "summary"]]  # which the ingest returned


def test_a_merge_that_stops_leaves_nothing(corpus, spark, monkeypatch):
    put(corpus, "b", pages(spark, ("http://x/9", "Nine", "ninth page text")))
    real, calls = Corpus.append, 0

    def failing(self, *args):
        nonlocal calls
        calls += 1
        if calls == 4:
            raise OSError("interrupted")
        return real(self, *args)

    with monkeypatch.context() as m:
        m.setattr(Corpus, "append", failing)
        with pytest.raises(OSError):
            merge_contexts(corpus, ["a", "b"], "both", now=NOW)
    assert not corpus.has_context("both") and corpus.read("chunks").select("context_id").distinct().count() == 2
    merge_contexts(corpus, ["a", "b"], "both", now=NOW)
    assert counts(corpus, "both")[0] == 3
    later = datetime(2024, 5, 5)
    merge_contexts(corpus, ["a", "b"], "both", now=later)
    assert corpus.list_contexts("both").first()["updated_at"] == later


def test_failed_pages_leave_a_row(corpus, spark):
    from doclake.plans.ingest import documents_from_pages

    rows = [("http://p/good", "<p>" + "words about tables " * 20), ("http://p/short", "<p>hi"), ("http://p/none", None),
            ("http://p/nested", "<nav><aside>menu</nav><p>" + "text after the menu " * 20)]
    out = store_processed(corpus, "b", documents_from_pages(spark.createDataFrame(rows, "url string, html string")), embedder=TEXT, snippet_embedder=CODE, now=NOW)
    got = {r["url"]: (r["status"], r["error"]) for r in out.collect()}
    assert got == {
        "http://p/good": ("processed", None),
        "http://p/nested": ("processed", None),
        "http://p/short": ("failed", "page has too little text"),
        "http://p/none": ("failed", "page has no html"),
    }
    assert corpus.read("documents", corpus.context_id("b")).count() == 2


def test_models_are_recorded_and_kept_apart(corpus, spark):
    assert corpus.embedding_model("a") == TEXT.name
    with pytest.raises(ValueError):
        store_processed(corpus, "a", pages(spark, ("u", "t", "text")), embedder=HashEmbedder(32), snippet_embedder=CODE, now=NOW)
    with pytest.raises(ValueError):
        search(corpus, "a", "tables", "vector", 3, embedder=HashEmbedder(32))
