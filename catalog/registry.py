"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions.patterns import re2
from doclake.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function under a name, with the equivalent SQL where there is one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for CPU-heavy work: over all slots even when the file has a single row group."""
    return spread(table(spark, sf_dir, name).select(*columns))


# Pieces of SQL text ---------------------------------------------------------------------------------------------------


def text_literal(value: str) -> str:
    """SQL expression for a string, newlines as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def pattern_literal(pattern: str, flags: str = "") -> str:
    return "'" + re2(pattern, flags).replace("'", "''") + "'"


def sql_replace(expr: str, pattern: str, replacement: str, flags: str = "") -> str:
    new = replacement.replace("$1", "\\1")
    return f"regexp_replace({expr}, {pattern_literal(pattern, flags)}, {text_literal(new)}, 'g')"


def sql_matches(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {pattern_literal(pattern, flags)})"


def sql_strip(expr: str) -> str:
    return sql_replace(expr, r"^\s+|\s+\z", "")


def sql_blank(expr: str) -> str:
    return f"(NOT {sql_matches(expr, r'[^\s]')})"


def sql_lines(expr: str) -> str:
    return f"string_split({expr}, chr(10))"


# Derived frames, in Spark and in SQL ----------------------------------------------------------------------------------

#: Documents as corpus documents: the source is the context, thirteen neighbours share a URL.
DOCS_SQL = """
docs AS (
  SELECT doc_id, source AS context_id, 'doc://' || CAST((doc_id // 13) % 60 AS VARCHAR) AS url,
         'Doc ' || CAST(doc_id AS VARCHAR) AS title, text AS content, lang,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS indexed_at
  FROM documents
)
"""


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("context_id"),
        F.concat(F.lit("doc://"), (F.floor(F.col("doc_id") / 13) % 60).cast("string")).alias("url"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        "lang",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("indexed_at"),
    )


#: Markdown made from every document: noise, headings, artefacts, two fences and one inline snippet round its text.
_HEAD = "# Notes\n## Part\nHome\nNext chapter\n"
_MIDDLE = "\n\n\n\nsee [empty]( ) and ***bold*** ..... what??? yes!!\n[![b](i)](l) tail [ ] end\n---\nEdit on GitHub\nok\n"


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    number = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit(_HEAD),
        F.col("text"),
        F.lit(_MIDDLE + "```python\nrows = load("),
        number,
        F.lit(")\n# note\nprint(rows)\n```\ncall `fetch_rows(table="),
        number,
        F.lit(", limit=10)` or `short`\n```\nSELECT count(*) FROM t"),
        number,
        F.lit(";\n```\nLast updated: today\nplease make a copy\n"),
    )
    return d.select("doc_id", F.col("source").alias("context_id"), "lang", text.alias("content"))


MARKDOWN_SQL = f"""
md AS (
  SELECT doc_id, source AS context_id, lang,
    {text_literal(_HEAD)} || text || {text_literal(_MIDDLE + '```python' + chr(10) + 'rows = load(')} || doc_id ||
    {text_literal(')' + chr(10) + '# note' + chr(10) + 'print(rows)' + chr(10) + '```' + chr(10) + 'call `fetch_rows(table=')}
    || doc_id || {text_literal(', limit=10)` or `short`' + chr(10) + '```' + chr(10) + 'SELECT count(*) FROM t')} ||
    doc_id || {text_literal(';' + chr(10) + '```' + chr(10) + 'Last updated: today' + chr(10) + 'please make a copy' + chr(10))}
    AS content
  FROM documents
)
"""
