"""Full-text retrieval by scanning texts, and by an index of postings.

A text matches when it contains every lexeme of the query. The rank is ``s / (1 + s)`` with s = BM25 (Robertson and
Zaragoza 2009), or with s = sum of (1 + ln tf) for ``ranker="tf"``, which needs no corpus statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.patterns import let
from doclake.functions.text import STOP_WORDS, lexemes, query_lexemes
from doclake.operators.vector_search import CHUNK_COLUMNS, LIMIT, best_per_query, by_score, code_fields, ranked, with_document

K1 = 1.2
B = 0.75
TERM_BUCKETS = 64
#: Words whose postings are grouped at a time; a batch of long texts has many times as many.
WORDS_AT_ONCE = 500_000


def idf(n_docs: int, doc_freq: int) -> float:
    return math.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))


def _bm25(tf: Column, length: Column, mean_length: float, weight: float) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean_length))
    return F.lit(weight) * tf * F.lit(K1 + 1) / (tf + norm)


def squash(s: Column) -> Column:
    return s / (F.lit(1.0) + s)


def _nothing(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))


def fulltext_hits(
    items: DataFrame,
    query: str,
    limit: int | None = LIMIT,
    id_col: str = "chunk_id",
    columns: tuple[str, ...] = (),
    text: str = "content",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
    ranker: str = "bm25",
) -> DataFrame:
    """Best matching rows by scanning ``text``.

    Without stemming a cheap substring test runs before the tokenizer. BM25 takes one extra pass for the number of
    texts, their mean length and the document frequencies, a single row that comes back as literals.
    """
    if ranker not in ("bm25", "tf"):
        raise ValueError("ranker must be bm25 or tf")
    terms = query_lexemes(query, stop_words, stemming)
    if not terms:
        return _nothing(items.select(id_col, *columns))
    words = lexemes(text, stop_words, stemming)

    def counted(lex: Column) -> Column:
        wanted = F.array(*[F.lit(t) for t in terms])
        tf = F.transform(wanted, lambda t: F.size(F.filter(lex, lambda x: x == t)).cast("double"))
        return F.struct(F.size(lex).alias("length"), tf.alias("tf"))

    narrow = items if stemming else items.where(reduce(lambda a, b: a & b, [F.lower(text).contains(t) for t in terms]))
    # One predicate over one expression: Catalyst pushes it below the projection, and the text is still cut into
    # lexemes once for the test and once more only for the few texts that match.
    narrow = narrow.select(id_col, *columns, let(words, counted).alias("_m"))
    narrow = narrow.where(F.forall("_m.tf", lambda n: n > 0))
    tf_of = lambda i: F.get(F.col("_m.tf"), F.lit(i))
    if ranker == "bm25":
        flags = [F.count_if(F.array_contains("_lex", t)).alias(f"df{i}") for i, t in enumerate(terms)]
        totals = items.select(words.alias("_lex")).agg(
            F.count("*").alias("n"), F.avg(F.size("_lex")).alias("mean"), *flags
        )
        stats = totals.first()
        if not stats["n"]:
            return _nothing(items.select(id_col, *columns))
        mean = stats["mean"] or 1.0
        parts = [
            _bm25(tf_of(i), F.col("_m.length"), mean, idf(stats["n"], stats[f"df{i}"])) for i in range(len(terms))
        ]
    else:
        parts = [F.lit(1.0) + F.log(tf_of(i)) for i in range(len(terms))]
    score = squash(reduce(lambda a, b: a + b, parts)).alias("score")
    hits = narrow.select(id_col, *columns, score).orderBy(*by_score(id_col))
    return hits if limit is None else hits.limit(limit)


def fulltext_search(chunks: DataFrame, documents: DataFrame, query: str, limit: int = LIMIT, **options) -> DataFrame:
    """Best chunks with the fields of their documents."""
    columns = ("doc_id", *(c for c in CHUNK_COLUMNS if c in chunks.columns))
    hits = fulltext_hits(chunks, query, limit, "chunk_id", columns, **options)
    return ranked(with_document(hits, documents), limit)


def fulltext_search_code(
    snippets: DataFrame, documents: DataFrame, query: str, limit: int = LIMIT, **options
) -> DataFrame:
    columns = tuple(c for c in ("doc_id", "content", "metadata") if c in snippets.columns)
    hits = fulltext_hits(snippets, query, limit, "snippet_id", columns, **options)
    return ranked(code_fields(hits, documents), limit, "snippet_id")


def _word_slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about WORDS_AT_ONCE words each; a text is never cut, texts without words are left out."""
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    low, done = 0, 0
    while low < len(ends) and ends[-1] > done:
        high = max(low + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, side="right")))
        if ends[high - 1] > done:
            yield low, high
        low, done = high, int(ends[high - 1])


def build_postings(
    items: DataFrame,
    id_col: str = "chunk_id",
    text: str = "content",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
    buckets: int = TERM_BUCKETS,
) -> DataFrame:
    """Postings (lexeme, id, tf, positions, text_length, term_bucket).

    A text is one row, so its postings are grouped where it is, batch by batch with Arrow; building needs no shuffle.
    """
    id_type = items.schema[id_col].dataType.simpleString()
    words = items.select(id_col, lexemes(text, stop_words, stemming).alias("words"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _word_slices(batch.column(1)):
                yield of_rows(batch.slice(low, high - low))

    def of_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        sizes = lists.value_lengths()
        parents = lists.value_parent_indices()
        flat = lists.flatten()
        first = pc.subtract(lists.offsets, lists.offsets[0]).take(parents)
        position = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int32)), first)
        table = pa.table({"row": parents, "lexeme": flat, "position": position})
        grouped = table.group_by(["row", "lexeme"], use_threads=False).aggregate(
            [("position", "count"), ("position", "list")]
        )
        row = grouped.column("row").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                grouped.column("lexeme").combine_chunks(),
                batch.column(0).take(row),
                grouped.column("position_count").combine_chunks().cast(pa.int32()),
                grouped.column("position_list").combine_chunks(),
                sizes.take(row).cast(pa.int32()),
            ],
            names=["lexeme", id_col, "tf", "positions", "text_length"],
        )

    schema = f"lexeme string, {id_col} {id_type}, tf int, positions array<int>, text_length int"
    return words.mapInArrow(group, schema).withColumn("term_bucket", term_bucket(F.col("lexeme"), buckets))


def term_bucket(lexeme: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def write_postings(postings: DataFrame, path: str) -> None:
    """Partitioned by term bucket; a frequent term is spread over several files by the rebalance.

    Sorted by lexeme inside, so that a query for a few lexemes skips row groups.
    """
    spread = postings.hint("rebalance", F.col("term_bucket")).sortWithinPartitions("term_bucket", "lexeme")
    spread.write.mode("overwrite").partitionBy("term_bucket").parquet(path)


def posting_statistics(postings: DataFrame, items: DataFrame) -> DataFrame:
    """Number of texts and mean number of lexemes, one row. The lexemes are counted from the stored postings."""
    total = postings.agg(F.sum("tf").cast("double").alias("lexemes"), F.lit(0).cast("long").alias("texts"))
    n = items.agg(F.lit(0.0).alias("lexemes"), F.count("*").alias("texts"))
    both = total.unionByName(n).agg(F.sum("texts").alias("n_texts"), F.sum("lexemes").alias("_lexemes"))
    return both.select("n_texts", (F.col("_lexemes") / F.greatest("n_texts", F.lit(1))).alias("mean_length"))


def text_statistics(
    items: DataFrame, text: str = "content", stemming: bool = False, stop_words: frozenset[str] | None = STOP_WORDS
) -> DataFrame:
    """The row of ``posting_statistics``, counted from the texts."""
    sizes = items.select(F.size(lexemes(text, stop_words, stemming)).alias("n"))
    total = sizes.agg(F.count("*").alias("n_texts"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("_lexemes"))
    return total.select("n_texts", (F.col("_lexemes") / F.greatest("n_texts", F.lit(1))).alias("mean_length"))


def postings_search(
    postings: DataFrame,
    statistics,
    query: str,
    limit: int | None = LIMIT,
    id_col: str = "chunk_id",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
    buckets: int = TERM_BUCKETS,
) -> DataFrame:
    """Best matches from the postings: only the buckets of the query's terms are read."""
    terms = query_lexemes(query, stop_words, stemming)
    if not terms:
        return _nothing(postings.select(id_col))
    hashes = postings.sparkSession.range(1).select(
        *[term_bucket(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(terms)]
    )
    own = postings.where(F.col("term_bucket").isin(list(set(hashes.first()))) & F.col("lexeme").isin(terms))
    frequency = {r["lexeme"]: r["n"] for r in own.groupBy("lexeme").agg(F.count("*").alias("n")).collect()}
    if len(frequency) < len(terms):
        return _nothing(postings.select(id_col))
    weight = reduce(
        lambda w, t: w.when(F.col("lexeme") == t, F.lit(idf(statistics["n_texts"], frequency[t]))), terms, F
    )
    tf = F.col("tf").cast("double")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("text_length") / F.lit(statistics["mean_length"]))
    part = weight * tf * F.lit(K1 + 1) / (tf + norm)
    matched = own.groupBy(id_col).agg(F.count("*").alias("_n"), F.sum(part).alias("_s"))
    hits = matched.where(F.col("_n") == len(terms)).select(id_col, squash(F.col("_s")).alias("score"))
    hits = hits.orderBy(*by_score(id_col))
    return hits if limit is None else hits.limit(limit)


def fulltext_search_batch(
    postings: DataFrame,
    statistics,
    queries: DataFrame,
    limit: int = LIMIT,
    id_col: str = "chunk_id",
    text: str = "text",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
) -> DataFrame:
    """Best matches for every query (query_id, text): texts that hold all of its terms.

    Candidates are the texts of a query's rarest term only. They are then looked up for each other term by (term, text), a
    key that no common word makes hot, so the work follows the rarest terms and not the common ones. Queries stay in Spark.
    """
    terms = queries.select("query_id", F.array_distinct(lexemes(text, stop_words, stemming)).alias("_terms"))
    terms = terms.select("query_id", F.size("_terms").alias("_wanted"), F.explode("_terms").alias("lexeme"))
    distinct_terms = terms.select("lexeme").distinct()
    frequency = postings.join(distinct_terms, "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("_df"))
    n, mean = F.lit(statistics["n_texts"]), F.lit(statistics["mean_length"])
    weighted = terms.join(frequency, "lexeme").withColumn(
        "_idf", F.log(F.lit(1.0) + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    )
    rarest = weighted.groupBy("query_id").agg(F.min_by("lexeme", F.struct("_df", "lexeme")).alias("lexeme"))
    candidates = postings.select("lexeme", id_col).join(rarest, "lexeme").select("query_id", id_col)
    asked = candidates.join(weighted.select("query_id", "lexeme", "_wanted", "_idf"), "query_id")
    tf = F.col("tf").cast("double")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("text_length") / mean)
    part = F.col("_idf") * tf * F.lit(K1 + 1) / (tf + norm)
    matched = (
        postings.select("lexeme", id_col, "tf", "text_length")
        .join(asked, ["lexeme", id_col])
        .groupBy("query_id", id_col)
        .agg(F.count("*").alias("_n"), F.first("_wanted").alias("_wanted"), F.sum(part).alias("_s"))
        .where(F.col("_n") == F.col("_wanted"))
    )
    return best_per_query(matched.select("query_id", id_col, squash(F.col("_s")).alias("score")), limit, id_col)
