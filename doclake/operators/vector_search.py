"""Exact vector retrieval: one query, or many queries at once."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.vectors import cosine_to, matrix, matrix_blocks, unit_rows
from doclake.schema import text_size

LIMIT = 10
MIN_SIMILARITY = 0.7
SEARCH_MIN_SIMILARITY = 0.1
#: Bytes of a block of queries or of items in a batch search, as numbers of eight bytes.
BLOCK_BYTES = 32 << 20
#: Pairs of blocks for each task slot, and rows of a block, that are wanted at least.
PAIRS_PER_SLOT, LEAST_ROWS = 4, 1024
#: Queries of a block scored at a time.
QUERIES_AT_ONCE = 256
#: With so many times the wanted number of items above the bar, the bar is raised before they are sorted.
CROWD = 4

#: Scores are compared to this many digits, so equal texts or vectors tie exactly and the id decides.
SCORE_DIGITS = 9


def by_score(id_col: str = "chunk_id", score: str = "score") -> list[Column]:
    return [F.desc(F.round(score, SCORE_DIGITS)), F.col(id_col)]


def vector_hits(
    items: DataFrame,
    query: Sequence[float],
    limit: int | None = LIMIT,
    min_similarity: float = MIN_SIMILARITY,
    id_col: str = "chunk_id",
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Best ``limit`` rows with ``score`` above the threshold, by score, then id.

    Each task keeps its own best rows (TakeOrderedAndProject), so only ``limit`` rows per task are moved.
    """
    scored = items.where(F.col("embedding").isNotNull()).select(
        id_col, *columns, cosine_to("embedding", query).alias("score")
    )
    hits = scored.where(F.col("score") > min_similarity).orderBy(*by_score(id_col))
    return hits if limit is None else hits.limit(limit)


CHUNK_COLUMNS = (
    "context_id", "content", "summary", "summary_model", "metadata", "chunk_index", "start_line", "end_line",
    "char_start", "char_end", "code_snippet_ids",
)


def with_document(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds title, URL, size, chunk total and metadata of the hit's document."""
    fields = documents.select(
        "doc_id",
        "title",
        "url",
        text_size(documents, "content_length").alias("parent_page_size"),
        *([F.col("chunk_count").alias("parent_total_chunks")] if "chunk_count" in documents.columns else []),
        *([F.col("metadata").alias("doc_metadata")] if "metadata" in documents.columns else []),
    )
    return hits.join(fields, "doc_id")


def ranked(hits: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Hits in order. The limit is that of the search already; repeating it spares a range-partitioned sort and
    tells Catalyst that the frame is small enough to broadcast."""
    return hits.orderBy(*by_score(id_col)).limit(limit)


def vector_search(
    chunks: DataFrame,
    documents: DataFrame,
    query: Sequence[float],
    limit: int = LIMIT,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """Best chunks with the fields of their documents; the documents join sees ``limit`` rows only."""
    columns = ("doc_id", *(c for c in CHUNK_COLUMNS if c in chunks.columns))
    hits = vector_hits(chunks, query, limit, min_similarity, "chunk_id", columns)
    return ranked(with_document(hits, documents), limit)


def vector_search_code(
    snippets: DataFrame,
    documents: DataFrame,
    query: Sequence[float],
    limit: int = LIMIT,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """Best snippets with URL and line count."""
    columns = tuple(c for c in ("doc_id", "content", "metadata") if c in snippets.columns)
    hits = vector_hits(snippets, query, limit, min_similarity, "snippet_id", columns)
    return ranked(code_fields(hits, documents), limit, "snippet_id")


def code_fields(hits: DataFrame, documents: DataFrame) -> DataFrame:
    from doclake.functions.code import line_count

    return hits.join(documents.select("doc_id", "url"), "doc_id").withColumn("line_count", line_count("content"))


class Best:
    """The ``k`` best items of each of ``n`` queries among those seen so far, by score, then by the smaller place.

    Only scores above the floor count. Once a query has ``k`` items, the score of the last is a bar for all that follow.
    """

    def __init__(self, n: int, k: int, floor: float | np.ndarray):
        self.k = k
        self.low = np.full(n, floor, np.float64)  # a score that may still count lies above it
        self.high = self.low.copy()  # one above this counts whatever its place; between them it ties with the last
        self.last = np.zeros(n, np.int64)  # place of the last
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.waiting = 0

    def see(self, scores: np.ndarray, at: np.ndarray, of: np.ndarray) -> None:
        """Scores of the queries ``of`` (rows) with the items at the places ``at`` (columns)."""
        above = scores > self.low[of][:, None]  # NaN is never above
        if scores.shape[1] > self.k and np.count_nonzero(above) > CROWD * self.k * len(of):
            # Many to begin with: the k-th of these items is a bar already.
            kth = np.partition(np.where(above, scores, -np.inf), scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            self.low[of] = np.maximum(self.low[of], np.round(kth, SCORE_DIGITS) - 0.6 * 10.0**-SCORE_DIGITS)
            above = scores > self.low[of][:, None]
        q, i = np.divmod(np.flatnonzero(above), scores.shape[1])
        s, q, i = scores[q, i], of[q], at[i]
        counts = (s > self.high[q]) | (i < self.last[q])
        if counts.any():
            self.parts.append((q[counts], i[counts], s[counts]))
            self.waiting += len(self.parts[-1][0])
            if self.waiting > self.k * len(self.low):
                self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of the best so far."""
        q, i, s = (np.concatenate(x) for x in zip(*self.parts))
        rounded = np.round(s, SCORE_DIGITS)
        order = np.lexsort((i, -rounded, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        full, order = order[place == self.k - 1], order[place < self.k]
        # Half a unit of the last digit and a little lie between scores that round alike and those that do not.
        unit = 10.0**-SCORE_DIGITS
        self.low[q[full]] = np.maximum(self.low[q[full]], rounded[full] - 0.6 * unit)
        self.high[q[full]], self.last[q[full]] = rounded[full] + 0.4 * unit, i[full]
        self.parts, self.waiting = [(q[order], i[order], s[order])], 0
        return self.parts[0]


def best_per_query(scored: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(*by_score(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _block_top(items: pa.Table, queries: pa.Table, k: int, floor: float, id_col: str) -> pa.Table:
    """Best ``k`` of a block of items for each query of a block."""
    items = items.sort_by(id_col).combine_chunks()  # so places stand for ids
    names = queries.column("query_id").to_numpy()
    vectors = queries.column("embedding").combine_chunks()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for dim in set(pc.list_value_length(vectors).to_pylist()) - {None, 0}:
        asked, of = matrix(vectors, dim)
        lying = [(unit_rows(rows), at) for rows, at in matrix_blocks(items.column("embedding").combine_chunks(), dim)]
        for low in range(0, len(of), QUERIES_AT_ONCE):
            unit, asking = unit_rows(asked[low : low + QUERIES_AT_ONCE]), names[of[low : low + QUERIES_AT_ONCE]]
            best, every = Best(len(unit), k, floor), np.arange(len(unit))
            for rows, at in lying:
                best.see(unit @ rows.T, at, every)
            q, at, scores = best.settled()
            out.append((asking[q], at, scores))
    query_ids, at, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0), np.empty(0, np.int64), np.empty(0))
    columns = [pa.array(query_ids, pa.int64()), items.column(id_col).take(pa.array(at)), pa.array(scores, pa.float64())]
    return pa.table(columns, names=["query_id", id_col, "score"])


def block_counts(n: int, m: int, dim: int, slots: int, block_rows: int | None = None) -> tuple[int, int]:
    """Into how many blocks ``n`` items and ``m`` queries of ``dim`` numbers are dealt.

    As few as hold ``BLOCK_BYTES`` each, since every block is sent once for each block of the other side; but enough that
    small tables too give every slot some pairs of blocks.
    """
    most = block_rows or max(1, BLOCK_BYTES // (8 * max(dim, 1)))
    wanted = math.ceil(math.sqrt(PAIRS_PER_SLOT * slots))
    blocks = lambda rows: max(1, -(-rows // most), min(wanted, -(-rows // LEAST_ROWS)))
    return blocks(n), blocks(m)


def vector_search_batch(
    items: DataFrame,
    queries: DataFrame,
    limit: int = LIMIT,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    id_col: str = "chunk_id",
    block_rows: int | None = None,
) -> DataFrame:
    """Best ``limit`` rows for every query (query_id, embedding): query_id, id, score, rank.

    Queries and items are dealt into blocks of bounded size (about ``block_rows`` rows, if given); a task scores one block of
    queries against one of items, and the best of each are merged. Only the two row counts and the longest vector's size come
    to the driver.
    """
    valid = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long"), "embedding")
    size = F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    here, asked = items.agg(F.count("*").alias("n"), size).first(), valid.agg(F.count("*").alias("n"), size).first()
    slots = items.sparkSession.sparkContext.defaultParallelism
    item_blocks, query_blocks = block_counts(here["n"], asked["n"], max(here["dim"], asked["dim"]), slots, block_rows)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind, none = items.schema[id_col].dataType.simpleString(), F.lit(None)
    lying = items.select(
        block(id_col, item_blocks).alias("_i"), every(query_blocks).alias("_q"), F.lit(False).alias("asks"),
        none.cast("long").alias("query_id"), id_col, "embedding",
    )
    asking = valid.select(
        every(item_blocks).alias("_i"), block("query_id", query_blocks).alias("_q"), F.lit(True).alias("asks"),
        "query_id", none.cast(kind).alias(id_col), "embedding",
    )
    both = lying.unionByName(asking).withColumn("key", F.col("_i") * query_blocks + F.col("_q")).drop("_i", "_q")
    # Each pair of blocks is a partition of its own: dealt by hash, some tasks would have several pairs and others none.
    dealt = both.repartitionById(item_blocks * query_blocks, "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, tuple[list[pa.RecordBatch], list[pa.RecordBatch]]] = defaultdict(lambda: ([], []))
        for batch in batches:
            keys, asks = batch.column("key"), batch.column("asks")
            for key in pc.unique(keys).to_pylist():
                mine = pc.equal(keys, key)
                for side, which in zip(sides[key], (pc.and_not(mine, asks), pc.and_(mine, asks))):
                    rows = batch.filter(which)
                    if rows.num_rows:
                        side.append(rows)
        for here, asked in sides.values():
            if here and asked:
                found = _block_top(pa.Table.from_batches(here), pa.Table.from_batches(asked), limit, min_similarity, id_col)
                yield from found.to_batches()

    scored = dealt.mapInArrow(score, f"query_id long, {id_col} {kind}, score double")
    return best_per_query(scored, limit, id_col)
