"""Exact deduplication by a content sort.

Rows are range-partitioned on (first characters, digest, id) with splitters that Spark samples; the external sort of each
task then puts equal texts next to each other, and a task compares each text in full with the one before. Because the id
is part of the key, a group of copies that holds a third of all rows is cut over many tasks. Only the first and last run
of a task can go on in another one; these runs, two rows per task, are merged at the end.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; NULL counts as empty, and empty texts equal
each other. Of equal texts the one with the most code points stays, then the one with the smallest id. Rows that repeat
an id with an equal text: the first of them stays. A row without an id stays, as a group of its own. An empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored, unused, without_space

#: Characters of a text in the sort key. Longer common beginnings are told apart by the digest.
KEY_CHARS = 48

_RUN_SCHEMA = (
    "doc_id long, n_chars long, text_sha256 string, keep_id long, keep_chars long, group_size long, first boolean, "
    "head boolean, open boolean"
)


_NAMES = [part.split(" ")[0] for part in _RUN_SCHEMA.split(", ")]
_LARGEST = np.iinfo(np.int64).max


def _rows(ids: np.ndarray, chars: np.ndarray, digests: pa.Array, starts: np.ndarray, opened: np.ndarray):
    """Result rows of whole runs; ``starts`` are the positions where a run begins, ``opened`` has a flag for each."""
    sizes = np.diff(np.append(starts, len(ids)))
    most = np.maximum.reduceat(chars, starts)
    longest = np.where(chars == np.repeat(most, sizes), ids, _LARGEST)
    keep = np.minimum.reduceat(longest, starts)
    head = np.zeros(len(ids), bool)
    head[starts] = True
    first = head.copy()
    first[1:] |= ids[1:] != ids[:-1]
    values = [ids, chars, digests, np.repeat(keep, sizes), np.repeat(most, sizes), np.repeat(sizes, sizes), first, head]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in [*values, np.repeat(opened, sizes)]], _NAMES)


class _Run:
    """The run that the next batch may go on with; of its rows only ids and lengths are held."""

    def __init__(self, digest: str, text: str, opens_task: bool):
        self.digest, self.text, self.opens_task = digest, text, opens_task
        self.ids: list[np.ndarray] = []
        self.chars: list[np.ndarray] = []

    def add(self, ids: np.ndarray, chars: np.ndarray) -> None:
        self.ids.append(ids)
        self.chars.append(chars)

    def rows(self, closes_task: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        digests = pa.array(np.full(len(ids), self.digest, object), pa.string())
        opened = np.array([self.opens_task or closes_task])
        return _rows(ids, np.concatenate(self.chars), digests, np.array([0]), opened)


def _same_as_before(digests: pa.Array, texts: pa.Array, run: _Run | None) -> np.ndarray:
    """Whether each text equals the one before it, in full; the digests must say the same."""
    n = len(texts)
    same = np.zeros(n, bool)
    alike = np.zeros(n, bool)
    if n > 1:
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        alike[1:] = pc.equal(digests.slice(1), digests.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    if run is not None:
        same[0] = run.text == texts[0].as_py()
        alike[0] = run.digest == digests[0].as_py()
    if not np.array_equal(same, alike):
        raise ValueError("different texts have the same SHA-256 digest")
    return same


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run: _Run | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        chars = batch.column("n_chars").to_numpy(zero_copy_only=False)
        digests, texts = batch.column("text_sha256"), batch.column("norm")
        starts = np.flatnonzero(~_same_as_before(digests, texts, run))
        before = starts[0] if len(starts) else batch.num_rows
        if before:
            run.add(ids[:before], chars[:before])
        if not len(starts):
            continue
        opens_task = run is None
        if run is not None:
            yield run.rows(False)
        last = starts[-1]
        if last > before:
            opened = np.zeros(len(starts) - 1, bool)
            opened[0] = opens_task
            inner = digests.slice(before, last - before)
            yield _rows(ids[before:last], chars[before:last], inner, starts[:-1] - before, opened)
        run = _Run(digests[last].as_py(), texts[last].as_py(), opens_task and last == before)
        run.add(ids[last:], chars[last:])
    if run is not None:
        yield run.rows(True)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    norm = without_space(F.col(text_col))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        norm.alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
    )
    keyed = rows.where(F.col("doc_id").isNotNull()).select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        "norm",
        F.left("norm", F.lit(KEY_CHARS)).alias("beginning"),
    )
    key = ["beginning", "text_sha256", "doc_id"]
    ordered = keyed.repartitionByRange(*key).sortWithinPartitions(*key, F.col("n_chars").desc()).drop("beginning")
    runs = stored(ordered.mapInArrow(_compare, _RUN_SCHEMA), "exact-runs")
    # Two runs per task at most are open, so this side has at most two rows for each of them.
    merged = (
        runs.where("open and head")
        .groupBy("text_sha256")
        .agg(
            F.max(F.struct("keep_chars", (-F.col("keep_id")).alias("minus_id"))).alias("best"),
            F.sum("group_size").alias("total"),
        )
        .select("text_sha256", F.lit(True).alias("open"), (-F.col("best.minus_id")).alias("best_id"), "total")
    )
    closed = runs.join(F.broadcast(merged), ["text_sha256", "open"], "left")
    keep = F.coalesce("best_id", "keep_id")
    named = closed.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("first") & (F.col("doc_id") == keep)).alias("kept"),
        "text_sha256",
        "n_chars",
    )
    alone = rows.where(F.col("doc_id").isNull()).select(
        "doc_id",
        F.lit(None).cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        "n_chars",
    )
    return named.unionByName(alone)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all of their columns. Rows without an id stay."""
    own_id, own_sha, own_chars = (unused(df.columns, n) for n in ("_kept_id", "_kept_sha", "_kept_chars"))
    kept = (
        exact_groups(df, id_col, text_col)
        .where("kept and doc_id is not null")
        .select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha), F.col("n_chars").alias(own_chars))
    )
    has_id = df.where(F.col(id_col).isNotNull())
    marks = {
        own_id: F.col(id_col).cast("long"),
        own_sha: F.sha2(F.encode(without_space(F.col(text_col)), "UTF-8"), 256),
        own_chars: F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
    }
    # An id may have several texts, each of which stays; only rows that repeat id and text are still there twice.
    stays = has_id.withColumns(marks).join(kept, list(marks), "left_semi").dropDuplicates(list(marks)).drop(*marks)
    return stays.select(*df.columns).unionByName(df.where(F.col(id_col).isNull()))
