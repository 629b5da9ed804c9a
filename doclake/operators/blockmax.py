"""Full-text top-k from posting blocks that carry their largest impact.

Texts are dealt into blocks by a hash of their id; a row of the index holds one lexeme's postings in one block, their number
and the largest impact (the BM25 part without the lexeme's weight) among them. A text matches when it holds every lexeme of
the query, so only blocks that hold all of them count, and the weighted sum of their largest impacts bounds every score in the
block. The blocks with the best bounds are evaluated first; the k-th score then drops all blocks whose bound lies below it.
Bounds are worked out from lexeme, block, number and impact alone: the postings of a dropped block are not looked at.

A common lexeme has one row per block, however many texts hold it, so no key is hot and no row is unbounded. The result
equals that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import STOP_WORDS, lexemes, query_lexemes
from doclake.operators.fulltext import K1, TERM_BUCKETS, B, _nothing, _word_slices, idf, squash, term_bucket
from doclake.operators.vector_search import LIMIT, SCORE_DIGITS, by_score

#: Texts of a block, about, and blocks evaluated before the k-th score is known, at least.
BLOCK_TEXTS, OPENING = 256, 8


def impact(tf: Column, length: Column, mean_length: float) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(float(mean_length or 1.0)))
    return tf.cast("double") * F.lit(K1 + 1) / (tf.cast("double") + norm)


def build_blocks(postings: DataFrame, statistics, id_col: str = "chunk_id", block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Posting blocks (lexeme, block, n, peak, postings, term_bucket) of postings and their statistics row."""
    blocks = max(1, int(statistics["n_texts"]) // block_texts)
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")
    held = F.struct(F.col(id_col).alias("id"), "tf", "text_length")
    return postings.groupBy("term_bucket", "lexeme", block).agg(
        F.count("*").alias("n"),
        F.max(impact(F.col("tf"), F.col("text_length"), statistics["mean_length"])).alias("peak"),
        F.collect_list(held).alias("postings"),
    )


def _counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Postings (lexeme, id, tf, text_length) of some texts (id, words)."""
    for low, high in _word_slices(batch.column("words")):
        part = batch.slice(low, high - low)
        lists = part.column("words")
        table = pa.table({"row": lists.value_parent_indices(), "lexeme": lists.flatten()})
        grouped = table.group_by(["row", "lexeme"], use_threads=False).aggregate([([], "count_all")])
        row = grouped.column("row").combine_chunks()
        columns = [part.column("id").take(row), grouped.column("count_all").cast(pa.int32()), lists.value_lengths().take(row)]
        yield pa.table([grouped.column("lexeme"), *columns], names=["lexeme", "id", "tf", "text_length"])


def _block_rows(block: int, parts: list[pa.Table]) -> pa.RecordBatch:
    """The postings of a block, one row per lexeme."""
    table = pa.concat_tables(parts)
    table = table.take(pc.sort_indices(table.column("lexeme")))
    lexeme, *fields = (table.column(c).combine_chunks() for c in ("lexeme", "id", "tf", "text_length"))
    first = np.append(True, pc.not_equal(lexeme[1:], lexeme[:-1]).to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(first).astype(np.int32)
    held = pa.StructArray.from_arrays(fields, names=["id", "tf", "text_length"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, np.int32(len(lexeme)))), held)
    blocks = pa.array(np.full(len(starts), block, np.int32))
    return pa.RecordBatch.from_arrays([lexeme.take(pa.array(starts)), blocks, lists], names=["lexeme", "block", "postings"])


def text_blocks(
    items: DataFrame,
    statistics,
    id_col: str = "chunk_id",
    text: str = "content",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
    buckets: int = TERM_BUCKETS,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """The posting blocks of ``build_blocks``, from the texts (``fulltext.text_statistics`` gives their statistics).

    The texts are dealt out by block, and a block's postings are grouped where its texts are: what is shuffled are the texts,
    not their postings, of which there are several times as many bytes.
    """
    blocks = max(1, int(statistics["n_texts"]) // block_texts)
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block")
    id_type = items.schema[id_col].dataType.simpleString()
    dealt = items.select(F.col(id_col).alias("id"), F.col(text).alias("text"), block)
    dealt = dealt.repartition(F.col("block")).sortWithinPartitions("block")
    words = dealt.select("id", "block", lexemes("text", stop_words, stemming).alias("words"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a block follow each other, but may go on in the next batch.
        current, parts = -1, []
        for batch in batches:
            number = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low and number[low] != current:
                    if parts:
                        yield _block_rows(current, parts)
                    current, parts = int(number[low]), []
                parts += _counted(batch.slice(low, high - low))
        if parts:
            yield _block_rows(current, parts)

    held = f"array<struct<id:{id_type},tf:int,text_length:int>>"
    rows = words.mapInArrow(group, f"lexeme string, block int, postings {held}")
    peaks = F.transform("postings", lambda p: impact(p["tf"], p["text_length"], statistics["mean_length"]))
    return rows.select(
        term_bucket(F.col("lexeme"), buckets).alias("term_bucket"),
        "lexeme",
        "block",
        F.size("postings").cast("long").alias("n"),
        F.array_max(peaks).alias("peak"),
        "postings",
    )


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Partitioned by term bucket, sorted by lexeme and block, so that a query for a few of them skips row groups and pages."""
    spread = blocks.hint("rebalance", F.col("term_bucket")).sortWithinPartitions("term_bucket", "lexeme", "block")
    spread.write.mode("overwrite").partitionBy("term_bucket").parquet(path)


def block_search(
    blocks: DataFrame,
    statistics,
    query: str,
    limit: int = LIMIT,
    id_col: str = "chunk_id",
    stemming: bool = False,
    stop_words: frozenset[str] | None = STOP_WORDS,
    buckets: int = TERM_BUCKETS,
) -> tuple[DataFrame, float]:
    """Best matches (id, score), and the share of the blocks that could match whose postings were read."""
    kind = blocks.schema["postings"].dataType.elementType["id"].dataType.simpleString()
    nothing = _nothing(blocks.select(F.lit(None).cast(kind).alias(id_col)))
    terms = query_lexemes(query, stop_words, stemming)
    if not terms:
        return nothing, 0.0
    spark = blocks.sparkSession
    hashes = spark.range(1).select(*[term_bucket(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(terms)])
    own = blocks.where(F.col("term_bucket").isin(list(set(hashes.first()))) & F.col("lexeme").isin(terms))
    frequency = {r["lexeme"]: r["n"] for r in own.groupBy("lexeme").agg(F.sum("n").alias("n")).collect()}
    if len(frequency) < len(terms):
        return nothing, 0.0
    weight = reduce(
        lambda w, t: w.when(F.col("lexeme") == t, F.lit(idf(statistics["n_texts"], frequency[t]))), terms, F
    )
    bounds = own.select("lexeme", "block", (weight * F.col("peak")).alias("part")).groupBy("block")
    bounds = bounds.agg(F.count("*").alias("held"), F.sum("part").alias("bound")).where(F.col("held") == len(terms))
    opened = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(OPENING, limit)).collect()]
    if not opened:
        return nothing, 0.0

    def evaluated(rows: DataFrame) -> DataFrame:
        each = rows.select("lexeme", weight.alias("weight"), F.explode("postings").alias("p"))
        part = F.col("weight") * impact(F.col("p.tf"), F.col("p.text_length"), statistics["mean_length"])
        texts = each.groupBy(F.col("p.id").alias(id_col)).agg(F.count("*").alias("held"), F.sum(part).alias("s"))
        hits = texts.where(F.col("held") == len(terms)).select(id_col, squash(F.col("s")).alias("score"))
        return hits.orderBy(*by_score(id_col)).limit(limit)

    # At most ``limit`` rows; they stand in the second list again as they are.
    some = evaluated(own.where(F.col("block").isin(opened))).collect()
    floor = some[-1]["score"] - 10.0**-SCORE_DIGITS if len(some) == limit else -1.0
    rest = bounds.where((squash(F.col("bound")) >= floor) & ~F.col("block").isin(opened)).select("block")
    n_all, n_rest = (bounds.count(), rest.count())
    known = spark.createDataFrame(some, f"{id_col} {kind}, score double")
    share = (len(opened) + n_rest) / n_all
    if not n_rest:
        return known.orderBy(*by_score(id_col)), share
    more = known.unionByName(evaluated(own.join(rest, "block", "left_semi")))
    return more.orderBy(*by_score(id_col)).limit(limit), share
