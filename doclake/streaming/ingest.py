"""Incremental ingest: new pages or files flow through the same functions as a batch.

The stream keeps one small state per URL, the digest and the time of the page stored last, so pages that come again
unchanged, or late, cost one comparison: they are neither cleaned nor written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doclake.functions.urls import url_key
from doclake.plans.ingest import documents_from_pages, store_processed
from doclake.session import shared_dir
from doclake.sources.corpus import Corpus

PAGE_SCHEMA = "url string, html string"


def page_stream(
    spark: SparkSession, folder: str, files_per_batch: int = 1000, names: str = "*.parquet", schema: str = PAGE_SCHEMA
) -> DataFrame:
    """Parquet files of fetched pages (url, html, and fetched_at if the schema says so) as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", names).parquet(folder)


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest page of a URL in this micro-batch, unless it is older than the stored one or has the same digest."""
    best: pd.DataFrame | None = None
    for frame in frames:
        both = frame if best is None else pd.concat([best, frame])
        best = both.sort_values(["at", "digest"]).iloc[[-1]]
    if best is None:
        return
    digest, at = best["digest"].iloc[0], int(best["at"].iloc[0])
    known, seen = state.get if state.exists else (None, at)
    if at >= seen:
        state.update((digest, at))
        if digest != known:
            yield best[["url", "html"]]


def changed_pages(pages: DataFrame) -> DataFrame:
    """Pages of a stream that are new for their URL: other content than the page passed on last, and not older.

    Time is ``fetched_at`` where the stream has it, else the order of micro-batches; equal times in one micro-batch go by the
    larger digest. Pages without a URL are known by their content. A group holds one page at a time, however often it
    was delivered.
    """
    digest = F.coalesce(F.sha2("html", 256), F.lit("none"))
    at = F.coalesce(F.unix_micros("fetched_at"), F.lit(0)) if "fetched_at" in pages.columns else F.lit(0)
    key = F.coalesce(url_key("url"), F.concat(F.lit("\u0000"), digest))
    known = pages.select(key.alias("page"), "url", "html", digest.alias("digest"), at.cast("long").alias("at"))
    return known.groupBy("page").applyInPandasWithState(
        _newest, PAGE_SCHEMA, "digest string, at long", "append", GroupStateTimeout.NoTimeout
    )


def ingest_stream(
    corpus: Corpus,
    name: str,
    pages: DataFrame,
    checkpoint: str | None = None,
    once: bool = True,
    interval: str = "1 minute",
    threshold: int = 15,
    **options,
) -> StreamingQuery:
    """Store the new and changed pages of every micro-batch in a context.

    What counts as changed is known to the stream's checkpoint: a document deleted from the context comes back when its
    page changes, or with a new checkpoint.

    Ids follow from context and URL and a document replaces its former self, so a batch that is run again after a
    failure leaves the same tables.
    """

    def store(batch: DataFrame, _: int) -> None:
        store_processed(corpus, name, documents_from_pages(batch, threshold), **options)

    writer = changed_pages(pages).writeStream.foreachBatch(store).option(
        "checkpointLocation", checkpoint or shared_dir(corpus.spark, "ingest-stream")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
