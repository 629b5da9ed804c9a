"""Exact vector retrieval through cells: bounds decide which cells are read, not a fixed number of them.

Vectors of length one lie in cells round centres; the table of cells holds each centre and the smallest and largest distance
of its vectors. By the triangle inequality a query at distance d from the centre is no nearer to any vector of the cell than
``d - largest`` or ``smallest - d``, which bounds the cosine from above. The cells with the best bounds are read first; the
score of the k-th hit then drops every cell whose bound lies below it. The result equals a scan of all vectors.

For a batch of queries the same bounds route each query to the cells it has to see: first to the nearest ones, whose k-th
score is a floor; then to all whose bound reaches it. Cells are put into groups of bounded size, so a query is sent once for a
group however many of its cells it has to see, and crowded cells are cut into parts of several groups.
"""

from __future__ import annotations

import math
from copy import copy
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.vectors import matrix, unit_rows
from doclake.operators.ann import assign_cells, train_cells, write_index
from doclake.operators.vector_search import (
    LIMIT,
    SCORE_DIGITS,
    SEARCH_MIN_SIMILARITY,
    Best,
    best_per_query,
    block_counts,
    by_score,
    vector_hits,
)

#: Vectors of a part of a cell, queries scored at a time, and vectors that they are scored against at a time.
PART_ROWS, STEP, ROWS_AT_ONCE = 4096, 512, 1024
#: Room for rounding in the bounds.
SLACK = 1e-6
#: Cells read before the k-th score is known hold at least this many times the wanted number of vectors.
FIRST_SHARE = 4


def cells_wanted(n: int) -> int:
    """About as many cells as a cell has vectors."""
    return max(1, math.isqrt(n))


def _distances(centres: np.ndarray, items: DataFrame) -> DataFrame:
    """Items (cell, embedding, ...) with their distance from the centre of their cell."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            away = np.linalg.norm(unit_rows(vectors.astype(np.float64)) - centres[batch.column("cell").to_numpy()], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(away)], ["cell", "away"])

    return items.select("cell", "embedding").mapInArrow(measure, "cell int, away double")


def build_cells(items: DataFrame, path: str, cells: int | None = None, **training) -> None:
    """Write ``items`` (an id, embedding, ...) by cell below ``path``, and the table of cells."""
    spark = items.sparkSession
    count = items.count()
    model: KMeansModel = train_cells(items, min(cells or cells_wanted(count), max(count, 1)), **training)
    centres = unit_rows(np.asarray(model.clusterCenters(), dtype=np.float64))
    write_index(assign_cells(items, model), f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    radii = _distances(centres, stored).groupBy("cell").agg(
        F.min("away").alias("smallest"), F.max("away").alias("largest"), F.count("*").alias("n")
    )
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    named.join(radii, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


class Bounds:
    """The table of cells, and what follows from it for queries. It travels to the tasks."""

    def __init__(self, rows: list):
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.centre = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1)
        self.smallest, self.largest, self.n = (np.array([r[c] for r in rows]) for c in ("smallest", "largest", "n"))

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosine of each query (rows of length one) with the vectors of each cell."""
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * queries @ self.centre.T))
        gap = np.maximum(0.0, np.maximum(away - self.largest, self.smallest - away) - SLACK)
        return np.minimum(1.0, 1.0 - gap * gap / 2.0) + SLACK

    def among(self, cells: np.ndarray) -> Bounds:
        """The table of these cells only, in their order."""
        out, at = copy(self), np.searchsorted(self.cell, cells)
        out.cell, out.centre = self.cell[at], self.centre[at]
        out.smallest, out.largest, out.n = self.smallest[at], self.largest[at], self.n[at]
        return out

    def first(self, order: np.ndarray, limit: int) -> int:
        """How many cells in the order of their bounds are read before the k-th score is known."""
        held = np.cumsum(self.n[order])
        return min(len(order), int(np.searchsorted(held, FIRST_SHARE * limit)) + 1)


class Cells:
    """A written index. The table of cells, whose size the index was given, comes to the driver."""

    def __init__(self, spark, path: str):
        self.items = spark.read.parquet(f"{path}/vectors")
        self.table = Bounds(spark.read.parquet(f"{path}/cells").orderBy("cell").collect())

    def search(
        self,
        query: Sequence[float],
        limit: int = LIMIT,
        min_similarity: float = SEARCH_MIN_SIMILARITY,
        id_col: str = "chunk_id",
        also: DataFrame | None = None,
        without: DataFrame | None = None,
    ) -> tuple[DataFrame, float]:
        """Best rows, and the share of the indexed vectors that was read.

        ``also`` (id, embedding) has vectors that are not in the index yet; ``without`` (doc_id) documents it should forget.
        """
        asked = unit_rows(np.asarray(query, np.float64)[None, :])
        table = self.table
        if not len(table.cell) or asked.shape[1] != table.centre.shape[1] or not np.isfinite(asked).all() or not asked.any():
            rest = self.items.select(id_col, "embedding") if also is None else self.items.select(id_col, "embedding").unionByName(also)
            return vector_hits(rest, query, limit, min_similarity, id_col), 1.0
        bound = table.upper(asked)[0]
        order = np.argsort(-bound, kind="stable")
        taken = table.first(order, limit)

        def hits(cells: np.ndarray, more: DataFrame | None) -> DataFrame:
            rows = self.items.where(F.col("cell").isin(cells.tolist()))
            if without is not None:
                rows = rows.join(without.select("doc_id"), "doc_id", "left_anti")
            rows = rows.select(id_col, "embedding")
            rows = rows if more is None else rows.unionByName(more.select(id_col, "embedding"))
            return vector_hits(rows, query, limit, min_similarity, id_col)

        # At most ``limit`` rows; they stand in the second list again as they are.
        some = hits(table.cell[order[:taken]], also).collect()
        floor = max(min_similarity, some[-1]["score"] if len(some) == limit else -1.0) - 10.0**-SCORE_DIGITS
        rest = order[taken:][bound[order[taken:]] >= floor]
        kind = self.items.schema[id_col].dataType.simpleString()
        known = self.items.sparkSession.createDataFrame(some, f"{id_col} {kind}, score double")
        share = float(table.n[order[:taken]].sum() + table.n[rest].sum()) / float(table.n.sum())
        if not len(rest):
            return known.orderBy(*by_score(id_col)), share
        more = known.unionByName(hits(table.cell[rest], None))
        return more.orderBy(*by_score(id_col)).limit(limit), share

    def search_batch(
        self, queries: DataFrame, limit: int = LIMIT, min_similarity: float = SEARCH_MIN_SIMILARITY, id_col: str = "chunk_id"
    ) -> DataFrame:
        """Best rows for every query (query_id, embedding): query_id, id, score, rank.

        Queries go to the groups of cells their bounds admit, in two rounds; no query comes to the driver, and no query is
        scored against a cell that its bound rules out.
        """
        table = self.table
        dim, kind = table.centre.shape[1], self.items.schema[id_col].dataType.simpleString()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where(F.size("embedding") == dim)
        m = asked.count()
        groups, blocks = block_counts(int(table.n.sum()), m, dim, self.items.sparkSession.sparkContext.defaultParallelism)
        parts = np.maximum(1, -(-table.n // PART_ROWS)).astype(np.int64)
        start = np.cumsum(parts) - parts
        group = _groups(np.repeat(table.n / parts, parts), groups)
        by_cell = lambda value: F.get(F.lit(_by_cell(table.cell, value)), F.col("cell"))
        part = F.pmod(F.xxhash64(id_col), by_cell(parts))
        items = self.items.where(F.size("embedding") == dim).select(
            id_col, "embedding", "cell", F.get(F.lit(group.tolist()), (by_cell(start) + part).cast("int")).alias("group")
        )
        member = np.zeros((len(table.cell), groups), np.float32)
        member[np.repeat(np.arange(len(parts)), parts), group] = 1

        def admitted(some: pa.RecordBatch, opening: bool) -> tuple[np.ndarray, np.ndarray]:
            """Positions of queries and, for each, which cells it has to see."""
            vectors, of = matrix(some.column("embedding"), dim)
            unit = unit_rows(vectors)
            bound, floor = table.upper(unit), some.column("floor").to_numpy()[of]
            if not opening:
                return of, bound >= floor[:, None]  # NaN is not
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(table.n[order], axis=1)
            wanted = np.zeros(bound.shape, bool)
            np.put_along_axis(wanted, order, held - table.n[order] < FIRST_SHARE * limit, axis=1)
            return of, wanted & np.isfinite(unit).all(axis=1)[:, None]

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (batch.slice(low, STEP) for batch in batches for low in range(0, batch.num_rows, STEP))

        def route(opening: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for some in slices(batches):
                    of, wanted = admitted(some, opening)
                    if opening:  # one part of each cell will do for a floor
                        q, c = np.nonzero(wanted)
                        cell, to = table.cell[c], group[start[c]]
                    else:
                        q, to = np.nonzero(wanted.astype(np.float32) @ member > 0)
                        cell = np.full(len(q), -1)
                    sent = some.take(pa.array(of[q]))
                    columns = [sent.column(c) for c in ("query_id", "embedding", "floor", "block")]
                    columns += [pa.array(cell.astype(np.int32)), pa.array(to.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "embedding", "floor", "block", "cell", "group"])

            return run

        def seen(opening: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                some = np.zeros(len(table.cell), bool)
                for batch in slices(batches):
                    some |= admitted(batch, opening)[1].any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(table.cell[some].astype(np.int32))], ["cell"])

            return run

        def met(asking: DataFrame, opening: bool) -> DataFrame:
            vector = asked.schema["embedding"].dataType.simpleString()
            asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            sent = asking.mapInArrow(
                route(opening), f"query_id long, embedding {vector}, floor double, block int, cell int, group int"
            )
            here, none = items, F.lit(None)
            if m < len(table.cell):  # few queries: cells that none has to see are not moved
                here = here.join(asking.mapInArrow(seen(opening), "cell int").distinct(), "cell", "left_semi")
            lying = here.select(
                F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "group", F.lit(False).alias("asks"), "cell",
                none.cast("long").alias("query_id"), none.cast("double").alias("floor"), id_col, "embedding",
            )
            asks = sent.select(
                "block", "group", F.lit(True).alias("asks"), "cell", "query_id", "floor", none.cast(kind).alias(id_col), "embedding"
            )
            both = lying.unionByName(asks).withColumn("key", F.col("group") * blocks + F.col("block")).drop("group", "block")
            dealt = both.repartitionById(groups * blocks, "key").sortWithinPartitions("key", "asks")
            score = _score(table, dim, limit, id_col)
            return best_per_query(dealt.mapInArrow(score, f"query_id long, {id_col} {kind}, score double"), limit, id_col)

        lowest = F.lit(float(min_similarity))
        floors = met(asked.withColumn("floor", lowest), True).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") >= limit, F.greatest(F.col("least") - 10.0**-SCORE_DIGITS, lowest))
        known = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce(floor, lowest))
        return met(known.select("query_id", "embedding", "floor"), False).select("query_id", id_col, "score", "rank")


def _by_cell(cell: np.ndarray, value: np.ndarray) -> list[int]:
    out = np.ones(int(cell.max()) + 1 if len(cell) else 1, np.int64)
    out[cell] = value
    return out.tolist()


def _groups(sizes: np.ndarray, groups: int) -> np.ndarray:
    """Group of each part: neighbours together, about as many vectors in each group."""
    middle = np.cumsum(sizes) - sizes / 2
    return np.minimum(groups - 1, middle * groups // max(1, sizes.sum())).astype(np.int64)


class _Group:
    """Vectors of some cells (or of parts of them), each cell's together; places go by id."""

    def __init__(self, rows: pa.Table, table: Bounds, dim: int, id_col: str):
        rows = rows.sort_by(id_col).combine_chunks()
        vectors, at = matrix(rows.column("embedding").chunk(0), dim)
        cell = rows.column("cell").to_numpy()[at]
        order = np.argsort(cell, kind="stable")
        self.unit, self.place, self.ids = unit_rows(vectors[order]), at[order], rows.column(id_col).chunk(0)
        cells, self.low = np.unique(cell[order], return_index=True)
        self.high = np.append(self.low[1:], len(order))
        self.table = table.among(cells)

    def best(self, asked: np.ndarray, target: np.ndarray, floor: np.ndarray, limit: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Query, id and score of the best of the target cell, or of all whose bound reaches the query's bar, for a target of -1."""
        best, bound = Best(len(asked), limit, floor), self.table.upper(asked)
        for j, cell in enumerate(self.table.cell):
            of = np.flatnonzero(np.where(target < 0, bound[:, j] >= best.low, target == cell))
            if len(of):
                mine = asked[of]
                for low in range(self.low[j], self.high[j], ROWS_AT_ONCE):
                    some = slice(low, min(low + ROWS_AT_ONCE, self.high[j]))
                    best.see(mine @ self.unit[some].T, self.place[some], of)
        q, at, scores = best.settled()
        return q, self.ids.take(pa.array(at)), scores


def _score(table: Bounds, dim: int, limit: int, id_col: str):
    """Queries against the vectors of each group, which come first; a task holds one group and reads queries in batches."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            number = batch.column("key").to_numpy()
            cuts = np.flatnonzero(np.diff(number) != 0) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == a:
                    continue
                if key != number[a]:
                    key, held, group = number[a], [], None
                mine = batch.slice(a, b - a)
                asks = mine.column("asks")
                lying, asking = mine.filter(pc.invert(asks)), mine.filter(asks)
                if lying.num_rows:
                    held.append(lying.select(["cell", id_col, "embedding"]))
                if not (asking.num_rows and held):
                    continue
                group = group or _Group(pa.Table.from_batches(held), table, dim, id_col)
                for low in range(0, asking.num_rows, STEP):
                    some = asking.slice(low, STEP)
                    vectors, of = matrix(some.column("embedding"), dim)
                    target, floor = (some.column(c).to_numpy()[of] for c in ("cell", "floor"))
                    q, ids, scores = group.best(unit_rows(vectors), target, floor, limit)
                    names = some.column("query_id").take(pa.array(of[q]))
                    yield pa.RecordBatch.from_arrays([names, ids, pa.array(scores)], ["query_id", id_col, "score"])

    return score
