"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. Each positive with score p asks for the best rows of other labels
whose scores lie in a window from ``low`` to ``high`` percent of p. The windows overlap, but their upper limits alone cut the
scores into disjoint slots: a slot reaches from one limit down to the next. Tasks keep the best ``negatives`` rows of each slot,
combiners merge them, and the best rows below a limit are its slot's followed by those of the lower slots, so one descending
pass over at most ``positives * negatives`` rows answers all windows; what then lies below a window's lower limit is left out.

Anchors are a stated set, searched against all rows in blocks. Rows are dealt by id into blocks of about BLOCK_ROWS, and the
anchors, the smaller side, are sent to every block once per pass; a task holds one block and reads anchors in batches. What
leaves a block for an anchor is ``positives`` rows in the first pass and ``negatives`` rows per slot in the second.

Components are rounded to floor(SCALE * x), so scores are exact integers: products run in double precision while all sums are
below 2**53 and in Python's integers otherwise; a score beyond 64 bits is held at the largest one. Rows without id, label or
vector, and rows whose vectors are empty or hold NULL or non-finite components, take no part. Only vectors with equally many
components are compared. Ties go to the smaller id. Of rows that repeat an id one takes part, that with the smallest label,
then the smallest vector. An anchor without positives, or with none in its windows, gives no rows, and so does an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a window in percent of the positive's score: LOW <= 100 * negative / positive <= HIGH.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a block, and anchors scored at a time.
BLOCK_ROWS, STEP = 32768, 128
_LIMIT = (1 << 63) - 1


def rounded(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x), as doubles."""
    return np.floor(float(SCALE) * flat.astype(np.float64)).reshape(-1, dim)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles."""
    largest = [float(np.abs(m).max(initial=0)) for m in (anchors, rows)]
    if largest[0] * largest[1] * anchors.shape[1] < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m.tolist()] for m in (anchors, rows))
    exact = [[sum(x * y for x, y in zip(p, q)) for q in b] for p in a]
    return np.array([[max(-_LIMIT, min(_LIMIT, s)) for s in row] for row in exact], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, ties in order of place; ties at the border cost no sort of all."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= border)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return rounded(column.flatten().to_numpy(zero_copy_only=False), dim)


class _Block:
    """The rows of one block, those of each number of components together, in order of id."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def rows(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if self.by_dim is None:
            self.by_dim = {}
            if self.parts:
                table = pa.Table.from_batches(self.parts).sort_by("vec_id").combine_chunks()
                dims = table.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    mine = table.filter(pa.array(dims == d)).combine_chunks()
                    ids, labels = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()
                    vectors = _matrix(mine.column("vector").combine_chunks(), d)
                    self.by_dim[d] = ids, labels, vectors
            self.parts = []
        return self.by_dim.get(dim)


def _searched(choose: Callable, names: list[str]) -> Callable:
    """Anchors against the rows of each block; rows of a block come first, ``choose`` gives what an anchor takes from it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if numbers[a] != number:
                    block, number = _Block(), numbers[a]
                part = batch.slice(a, b - a)
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                if not asks.all():
                    block.parts.append(part.filter(pa.array(~asks)))
                anchors = part.filter(pa.array(asks))
                dims = anchors.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    rows = block.rows(d)
                    if rows is None:
                        continue
                    mine = anchors.filter(pa.array(dims == d))
                    for low in range(0, mine.num_rows, STEP):
                        some = mine.slice(low, STEP)
                        scores = products(_matrix(some.column("vector"), d), rows[2])
                        found = choose(some, scores, rows[0], rows[1])
                        if len(found[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names)

    return search


def _stacked(found: list[tuple]) -> tuple:
    if not found:
        return (np.zeros(0, np.int64),)
    return tuple(np.concatenate(c) for c in zip(*found))


def _positives(k: int) -> Callable:
    def choose(anchors, scores, ids, labels):
        found = []
        for row, anchor, label in zip(scores, anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist()):
            mates = np.flatnonzero((labels == label) & (ids != anchor))
            top = mates[best(row[mates], k)]
            found.append((np.full(len(top), anchor), ids[top], row[top]))
        return _stacked(found)

    return choose


def _slots(k: int) -> Callable:
    def choose(anchors, scores, ids, labels):
        found = []
        columns = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "limits", "least"))
        for row, anchor, label, limits, least in zip(scores, *columns):
            # Slot t holds the scores from limit t down to above limit t + 1; the last one ends at the lowest bound asked for.
            wanted = np.flatnonzero((labels != label) & (row <= limits[0]) & (row >= least))
            slot = len(limits) - 1 - np.searchsorted(np.array(limits[::-1]), row[wanted])
            for t in np.unique(slot).tolist():
                mine = wanted[slot == t]
                top = mine[best(row[mine], k)]
                found.append((np.full(len(top), anchor), np.full(len(top), t, np.int32), ids[top], row[top]))
        return _stacked(found)

    return choose


def valid_rows(df: DataFrame) -> DataFrame:
    """vec_id, label, dim and vector of the rows that take part, one for each id."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vec_id is not null and label is not null and size(vector) > 0")
    return rows.where(~bad).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select(
        "vec_id", "row.label", F.size("row.vector").alias("dim"), "row.vector"
    )


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of ``valid_rows``."""
    rows = stored(rows, "mining-rows")
    blocks = max(1, -(-rows.count() // block_rows))
    none = [F.lit(None).cast("array<bigint>").alias("limits"), F.lit(None).cast("bigint").alias("least")]
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select(block, F.lit(False).alias("asks"), "vec_id", "label", "dim", "vector", *none)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def searched(anchors: DataFrame, choose: Callable, columns: str) -> DataFrame:
        asking = anchors.select(every, F.lit(True).alias("asks"), "vec_id", "label", "dim", "vector", "limits", "least")
        met = dealt.unionByName(asking).repartition("block").sortWithinPartitions("block", "asks")
        return met.mapInArrow(_searched(choose, [c.split(" ")[0] for c in columns.split(", ")]), columns)

    def first(df: DataFrame, k: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(is_anchor)
    mates = searched(anchors.select("*", *none), _positives(positives), "anchor_id long, other_id long, score long")
    nearest = stored(first(mates, positives, "anchor_id"), "positives")
    # floor and ceil of the window's bounds in whole numbers; a negative positive score has an empty window.
    upper = F.floor(F.col("score").cast("decimal(38,0)") * high / 100).cast("bigint")
    lower = F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("bigint")
    windows = (
        nearest.where("score >= 0")
        .withColumns({"upper": upper, "lower": lower})
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    )
    asking = stored(anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]), "windows")
    columns = "anchor_id long, slot int, other_id long, score long"
    kept = first(searched(asking, _slots(negatives), columns), negatives, "anchor_id", "slot")
    # Slots are disjoint, so in descending order the best rows below a limit are those from its slot on.
    runs = kept.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "other_id", "slot"))).alias("run")
    )
    place = F.array_position("limits", F.col("upper")).cast("int") - 1
    below = F.slice(F.filter("run", lambda r: r["slot"] >= F.col("place")), 1, negatives)
    return (
        nearest.where("score >= 0")
        .withColumns({"upper": upper, "lower": lower})
        .join(windows.select("anchor_id", "limits"), "anchor_id")
        .join(runs, "anchor_id")
        .withColumn("place", place)
        .withColumn("answer", F.filter(below, lambda r: -r["minus"] >= F.col("lower")))
        .select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode("answer"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("col.other_id").alias("negative_id"),
            "positive_score",
            (-F.col("col.minus")).alias("negative_score"),
        )
    )


def mine_table(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The contract's anchors (every hundredth id) and labels (every seventh id moved on by one)."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    plain = df.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return mine(valid_rows(plain.withColumn("label", moved)), F.col("vec_id") % 100 == 0, block_rows=block_rows)
