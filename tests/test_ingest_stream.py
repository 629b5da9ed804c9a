"""A stream of pages delivered twice, late and changed, against the ingest of the newest pages as one batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from doclake.functions.vectors import HashEmbedder
from doclake.plans.ingest import documents_from_pages, store_processed
from doclake.sources.corpus import Corpus
from doclake.streaming.ingest import changed_pages, ingest_stream, page_stream

START = datetime(2024, 1, 1)
SCHEMA = "url string, html string, fetched_at timestamp"


def page(n, version):
    words = " ".join(f"word{n}x{version}x{k}" for k in range(40))
    return f"<html><head><title>Page {n}</title></head><body><h1>Page {n}</h1><p>{words}</p></body></html>"


def deliveries():
    """Per micro-batch: (page, version, hour), or a page without a URL."""
    first = [(n, 0, 1) for n in range(12)]
    again = [(n, 0, 1 + n % 2) for n in range(12)] + [(3, 1, 5), (4, 1, 5), (4, 2, 6)]
    late = [(3, 0, 2), (4, 1, 5), (5, 1, 7), (5, 2, 6)]
    back = [(4, 0, 8), (5, 1, 9)]
    return [first, again, late, back]


def rows(batch):
    return [(f"https://x.org/p{n}" + "/" * (hour % 2), page(n, version), START + timedelta(hours=hour)) for n, version, hour in batch]


def test_only_changes_pass_and_the_stream_equals_a_batch(spark, tmp_path):
    folder, out = str(tmp_path / "pages"), []
    check = str(tmp_path / "check")
    options = {"embedder": HashEmbedder(16), "snippet_embedder": HashEmbedder(16), "now": START}
    streamed = Corpus(spark, str(tmp_path / "a"), buckets=2)
    streamed.register(spark.createDataFrame([("c",)], "name string"), START)
    for batch in deliveries():
        df = spark.createDataFrame(rows(batch) + [(None, page(99, 0), None)], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(folder)
        ingest_stream(streamed, "c", page_stream(spark, folder, schema=SCHEMA), checkpoint=check, **options).awaitTermination()
        passed = changed_pages(page_stream(spark, folder, schema=SCHEMA)).writeStream.foreachBatch(
            lambda b, _: out.append(sorted((r["url"] or "", r["html"]) for r in b.collect()))
        )
        passed.option("checkpointLocation", check + "-only").trigger(availableNow=True).start().awaitTermination()
    assert [len(b) for b in out] == [13, 2, 1, 1]
    newest = {}
    for batch in deliveries():
        for n, version, hour in batch:
            newest[n] = max(newest.get(n, (0, 0)), (hour, version))
    batch = [(n, version, hour) for n, (hour, version) in newest.items()]
    whole = Corpus(spark, str(tmp_path / "b"), buckets=2)
    whole.register(spark.createDataFrame([("c",)], "name string"), START)
    store_processed(whole, "c", documents_from_pages(spark.createDataFrame(rows(batch), SCHEMA).select("url", "html")), **options)
    digests = lambda c: sorted(map(tuple, c.read("documents").select("doc_id", F.sha2("content", 256)).collect()))
    assert digests(streamed) == digests(whole)
