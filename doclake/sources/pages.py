"""Fetched pages (url, html) as markdown pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.html import EXCLUDED_TAGS, to_markdown
from doclake.functions.urls import page_title


def pages_to_markdown(df: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TAGS, html: str = "html") -> DataFrame:
    """Replaces ``html`` by title and markdown; the title falls back to one made from the URL.

    Only the HTML goes to Python; every other column stays in the JVM.
    """
    parsed = df.withColumn("_page", to_markdown(F.col(html), excluded)).drop(html)
    return (
        parsed.withColumn("title", page_title(F.col("_page.title"), F.col("url")))
        .withColumn("markdown", F.col("_page.markdown"))
        .withColumn("error", F.col("_page.error"))
        .drop("_page")
    )
