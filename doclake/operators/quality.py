"""Page filter, page scoring and the crawl summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.cleaning import clean_markdown
from doclake.functions.patterns import strip
from doclake.functions.text import relevance
from doclake.functions.urls import page_title

WORD_COUNT_THRESHOLD = 15


def quality_enough(text: str = "markdown", threshold: int = WORD_COUNT_THRESHOLD) -> Column:
    """Whether a page has at least five characters per word of the threshold."""
    return F.length(strip(text)) >= threshold * 5


def filter_quality(df: DataFrame, threshold: int = WORD_COUNT_THRESHOLD, text: str = "markdown") -> DataFrame:
    """Keep pages with enough text."""
    return df.where(quality_enough(text, threshold))


def score_pages(df: DataFrame, keywords: list[str] | None = None, text: str = "markdown") -> DataFrame:
    """Pages of (url, title, markdown) with cleaned content, its length, title and relevance."""
    cleaned = df.withColumn("content", clean_markdown(text)).withColumn("title", page_title("title", "url"))
    return cleaned.withColumn("length", F.length("content")).withColumn("relevance_score", relevance("content", keywords))


def crawl_summary(found: DataFrame, extracted: DataFrame, scored: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, total and average length and mean relevance, over everything or per key.

    The page list itself (url, title, score) is the ``extracted`` frame; it is not folded into the summary row.
    """
    # One aggregation over both inputs tagged by origin: no join, and empty inputs still give a row.
    tagged = found.select(*keys, F.lit(0).alias("done"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("double").alias("score"))
    tagged = tagged.unionByName(
        extracted.select(*keys, F.lit(1).alias("done"), F.col("length").cast("long").alias("length"), F.col("relevance_score").cast("double").alias("score"))
    )
    done = F.sum("done")
    total = F.coalesce(F.sum("length"), F.lit(0))
    mean = F.coalesce(F.avg("score"), F.lit(1.0)) if scored else F.lit(1.0)
    return tagged.groupBy(*keys).agg(
        F.coalesce(F.sum(1 - F.col("done")), F.lit(0)).alias("pages_found"),
        F.coalesce(done, F.lit(0)).alias("pages_extracted"),
        total.alias("total_content_length"),
        F.when(done > 0, F.floor(total / done)).otherwise(0).cast("long").alias("average_page_size"),
        mean.alias("average_relevance_score"),
    )
