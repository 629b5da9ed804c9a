"""Removal of repeated passages with a distributed difference-cover suffix array.

Every byte goes that lies in a string of WINDOW bytes which also starts earlier, in a document with a smaller id or before in
the same one. Strings are judged on the input; they never cross documents.

**What is sorted.** Text that no other text shares needs no place in the order. Every window holds the least of its GRAM-byte
grams by hash (an anchor); equal windows hold equal anchors, so only windows around anchors that occur twice are cut out, in
phrases that reach from one such anchor to the next and WINDOW - 1 bytes further. A phrase is told by its content alone, by two
64-bit hashes; equal phrases have equal suffixes and are sorted once, with their first place and all others behind it. What
different phrases share is narrowed down twice more, by longer grams. None of these steps loses a window that stands in two phrases.

**The difference cover.** Of the positions of the phrases those with remainder 1 or 2 by three are the sample, whose names are
its triples; of their string again two thirds are the sample, and so on. Triples of 1, 3 and 9 bytes name themselves; the
triples of 9 bytes (27 bytes) at the positions of the third level are sorted and named, and the recursion ends with the fourth
level, whose strings of four names cover more than a window. Going back, each level merges the positions that were not in its
sample with those that were: a position compares with one of the first kind by a character and a rank, with one of the second
kind by two characters and a rank. After the last merge all windows stand in the order of their bytes, to a window's length at
least, equal ones side by side: neighbours are compared, and of a run of equal windows all but the earliest are covered. The
other places of a phrase, which come after its first, are covered whole.

**On Spark.** Texts are sorted by document once and kept as rows of about BLOCK_BYTES (a longer text is one row), numbered in
order, so a place in a block is a place in the order of all texts. Windows that follow each other are joined to stretches of
bounded length, so ranks at neighbouring positions are found in the task that holds the stretch. Ordering goes to buckets between
sampled 27-byte beginnings, the same ones on every level, so that no comparison crosses buckets. Each level is one job of two
shuffles and one written table of ranks. What goes between a block, or a group of stretches, and a bucket of grams, phrases or
positions is one row of packed numbers, so the rows Spark handles are few and their sizes follow from the two numbers of parts.

Documents are ordered by id, NULL first, those that share an id by a hash of their texts. Rows with the same id and text count
as one document and come back each with the same result. NULL text counts as empty. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.session import shared_dir

WINDOW = 100
#: Bytes of the grams that anchor windows; a window holds SPREAD of them.
GRAM = 36
SPREAD = WINDOW - GRAM + 1
#: Longer ones narrow down what different phrases share.
LONG_GRAMS = (80, 96)
#: Bytes of text in a block, about, its documents at most, and bytes of blocks that a task holds at once.
BLOCK_BYTES, BLOCK_DOCS, TASK_BYTES = 2_000_000, 20_000, 32_000_000
#: Numbers of a block within its task, and of a stretch within its block: bits.
BLOCK_BITS, STRETCH_BITS = 12, 25
#: Anchors or phrases that meet in a task, about.
MEETING = 1_500_000
#: Window starts hashed at a time, few enough that the numbers stay in a processor's cache.
SLICE = 32_768
#: Window starts of a stretch at most, its bytes, and zeros behind it (room to look four names further).
STARTS = 1024
STRETCH = STARTS + WINDOW
ROOM = 5 * 27
#: Bytes of results handed on at a time.
SLICE_BYTES = 4_000_000
#: Positions in a bucket, about, and sampled beginnings per bucket.
BUCKET_ROWS, PER_BUCKET = 400_000, 40
BEGINNING = 27
#: Bits of an offset in a stretch.
PLACE_BITS = 11
LOCAL_BITS = 32
#: Positions after the last window start whose ranks each level still needs.
REACH = (0, 2, 8, 26, 80)


# Written tables ---------------------------------------------------------------------------------------------------------


class _Tables:
    """Written tables of one run, each deleted as soon as no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark, f"suffix-{name}")
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, None)
        # A written table cuts the lineage, so the shuffle files behind it can go when the write ends.
        self.spark.conf.set(setting, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(setting) if before is None else self.spark.conf.set(setting, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# Blocks, anchors and phrases --------------------------------------------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Longest phrase.
_LONGEST = SPREAD - 1 + WINDOW


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd number and of its inverse."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 1 << 62)) * 4 + 3
    n = SLICE + _LONGEST + 1
    table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    return table, _powers(np.uint64(base), n), _powers(np.uint64(pow(base, -1, 1 << 64)), n)


_ONE, _TWO = _constants(7), _constants(11)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _sums(data: np.ndarray, constants: tuple) -> np.ndarray:
    table, powers, _ = constants
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers[: len(data)], out=sums[1:])
    return sums


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes in a slice, by differences of running sums."""
    sums = _sums(data, _ONE)
    out = sums[gram:] - sums[:-gram]
    out *= _ONE[2][: len(out)]
    return _scrambled(out)


def string_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two hashes (rows) of strings of at most _LONGEST bytes at ascending begins."""
    out = np.empty((2, len(begins)), np.uint64)
    cuts = np.searchsorted(begins, np.arange(0, len(data) + SLICE, SLICE))
    for k, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if i == j:
            continue
        part = data[k * SLICE : (k + 1) * SLICE + _LONGEST]
        a = begins[i:j] - k * SLICE
        n = sizes[i:j]
        for row, constants in zip(out, (_ONE, _TWO)):
            sums = _sums(part, constants)
            row[i:j] = _scrambled((sums[a + n] - sums[a]) * constants[2][a] + n.astype(np.uint64))
    return out


def anchors(data: np.ndarray, wanted: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places of the least gram of each wanted window (of equal ones the first), and the hashes of these grams."""
    spread = WINDOW - gram + 1
    low = np.uint64(0xFFFFFFFF)
    count = np.arange(SLICE + WINDOW, dtype=np.uint64)
    all_places, all_hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(wanted), SLICE):
        mine = wanted[begin : begin + SLICE]
        if not mine.any():
            continue
        hashes = gram_hashes(data[begin : begin + len(mine) + WINDOW - 1], gram)
        least = hashes & ~low
        least |= count[: len(least)]
        span = 1
        while span * 2 <= spread:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = spread - span
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        places = least if mine.all() else least[mine]
        places = (places[np.append(True, places[1:] != places[:-1])] & low).astype(np.int64)
        all_places.append(places + begin)
        all_hashes.append(hashes[places])
    places, hashes = np.concatenate(all_places), np.concatenate(all_hashes)
    new = np.append(True, places[1:] != places[:-1])[: len(places)]
    return places[new], hashes[new]


def _mask(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a range; ranges may overlap."""
    edges = np.bincount(begins, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(ends, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after another, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_BLOCK = "block long, doc_id binary, has_id binary, length binary, copies binary, n_bytes long, body binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for v, k in zip(zip(*rows), kinds)], list(names))


def _pack_blocks(block_bytes: int) -> Callable:
    """Blocks of documents in order; rows with the same id and text are one document and counted as its copies."""
    return lambda batches: _packed_blocks(batches, block_bytes)


def _packed_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << BLOCK_BITS
    end = number + (1 << BLOCK_BITS)
    docs: list[list] = []
    size, last = 0, None

    def packed() -> pa.RecordBatch:
        if number >= end:
            raise ValueError("more blocks in a task than can be numbered: raise spark.sql.shuffle.partitions")
        ids, texts, copies = zip(*docs)
        row = [number, np.array([i or 0 for i in ids], np.int64).tobytes(), bytes(i is not None for i in ids)]
        row += [np.array([len(t) for t in texts], np.int64).tobytes(), np.array(copies, np.int64).tobytes(), size]
        return _rows(_BLOCK, [(*row, b"".join(texts))])

    for batch in batches:
        for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "body"))):
            if docs and last == (doc_id, text_hash) and docs[-1][1] == text:
                docs[-1][2] += 1
                continue
            if docs and (size + len(text) > block_bytes or len(docs) == BLOCK_DOCS):
                yield packed()
                docs, size, number = [], 0, number + 1
            docs.append([doc_id, text, 1])
            size, last = size + len(text), (doc_id, text_hash)
    if docs:
        yield packed()


def _starts(length: bytes) -> np.ndarray:
    return np.append(0, np.cumsum(np.frombuffer(length, np.int64)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, np.ndarray]]]:
    """The rows of a task, each with the answers to every step that came for its block."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    del tables
    lead = pc.is_valid(table.column("body"))
    answers: dict[int, dict[int, list]] = {}
    for block, step, codes in zip(*(table.filter(pc.invert(lead)).column(c).to_pylist() for c in ("block", "step", "codes"))):
        answers.setdefault(block, {}).setdefault(step, []).append(codes)
    leads = table.filter(lead)
    for k in range(leads.num_rows):
        row = leads.slice(k, 1).to_pylist()[0]
        yield row, {s: np.frombuffer(b"".join(c), np.int64) for s, c in answers.get(row["block"], {}).items()}


_MEET = "bucket int, block long, codes binary, one binary, two binary"
_ANSWER = "block long, step int, codes binary"


def _dealt(block: int, buckets: int, codes: np.ndarray, one: np.ndarray, two: np.ndarray | None = None) -> list[tuple]:
    """One row for each bucket, dealt by the lower half of the first number: anchors are chosen by the upper one, which is small."""
    bucket = ((one & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rest = (lambda mine: two[mine].tobytes()) if two is not None else (lambda mine: None)
    parts = np.split(order, cuts) if len(order) else []
    return [(int(bucket[m[0]]), block, codes[m].astype(np.uint32).tobytes(), one[m].tobytes(), rest(m)) for m in parts]


def _ask_anchors(gram: int, buckets: int) -> Callable:
    """Anchors; those whose gram occurs twice in a block are known to repeat, and one of them goes on to meet the others'."""

    def rows(block: int, data: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch | None:
        places, grams = anchors(data, wanted, gram)
        order = np.argsort(grams, kind="stable")
        same = np.zeros(len(grams), bool)
        same[1:] = grams[order[1:]] == grams[order[:-1]]
        known = np.sort(order[same | np.append(same[1:], False)]) if len(order) else order
        speaker = np.sort(order[~same])
        out = _dealt(block, buckets, places[speaker], grams[speaker])
        if len(known):
            out.append((((block >> BLOCK_BITS) + block) % buckets, block, places[known].astype(np.uint32).tobytes(), None, None))
        return _rows(_MEET, out) if out else None

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("block", "length", "body")}
                data = np.frombuffer(row["body"].as_buffer(), np.uint8)
                if len(data) < WINDOW:
                    continue
                starts = _starts(row["length"].as_py())
                end = np.repeat(starts[1:], np.diff(starts))[: len(data) - WINDOW + 1]
                found = rows(row["block"].as_py(), data, end - np.arange(len(end)) >= WINDOW)
                if found is not None:
                    yield found

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _gathered(batches):
            found = rows(row["block"], np.frombuffer(row["body"], np.uint8), _wanted(row, answers))
            if found is not None:
                yield found

    return of_blocks if gram == GRAM else of_pieces


def _meeting(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray | None, pa.Table] | None:
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return None
    table = pa.Table.from_batches(tables)
    sent = table.filter(pc.is_valid(table.column("one")))
    codes = [np.frombuffer(c, np.uint32) for c in sent.column("codes").to_pylist()]
    flat = lambda c: np.frombuffer(b"".join(v or b"" for v in sent.column(c).to_pylist()), np.uint64)
    return sent.column("block").to_pylist(), codes, flat("one"), flat("two"), table


def _answers(step: int, blocks: list[int], codes: list[np.ndarray], chosen: np.ndarray) -> pa.RecordBatch | None:
    cuts = np.cumsum([len(c) for c in codes])[:-1]
    rows = [(b, step, c[m].astype(np.int64).tobytes()) for b, c, m in zip(blocks, codes, np.split(chosen, cuts)) if m.any()]
    return _rows(_ANSWER, rows) if rows else None


def _repeated(step: int) -> Callable:
    """The places of grams that come more than once."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _meeting(batches)
        if found is None:
            return
        blocks, codes, grams, _, table = found
        known = table.filter(pc.is_null(table.column("one")))
        for block, packed in zip(known.column("block").to_pylist(), known.column("codes").to_pylist()):
            yield _rows(_ANSWER, [(block, step, np.frombuffer(packed, np.uint32).astype(np.int64).tobytes())])
        if not blocks:
            return
        order = np.argsort(grams)
        same = np.append(grams[order[1:]] == grams[order[:-1]], False)
        chosen = np.zeros(len(grams), bool)
        chosen[order] = same | np.append(False, same[:-1])
        out = _answers(step, blocks, codes, chosen)
        if out is not None:
            yield out

    return meet


_PHRASES = "block long, places binary, begins binary, sizes binary, cores binary, n_phrases int, body binary"


def _joined(begins: np.ndarray, ends: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Runs of overlapping or touching ascending ranges with a zero behind each: places before, moves of ranges, and bytes."""
    new = np.append(True, begins[1:] > np.maximum.accumulate(ends)[:-1])
    first = np.flatnonzero(new)
    a, e = begins[first], np.maximum.reduceat(ends, first)
    at = np.append(0, np.cumsum(e - a + 1)[:-1])
    body = b"".join(part for x, y in zip(a.tolist(), e.tolist()) for part in (text[x:y], b"\0"))
    return np.stack([at, a], axis=1), (at - a)[np.cumsum(new) - 1], body


def _stood(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where in its block a byte of runs stood."""
    run = np.searchsorted(places[:, 0], at, side="right") - 1
    return at - places[run, 0] + places[run, 1]


def _cut_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of a block around anchors that repeat, with its phrases."""
    for row, answers in _gathered(batches):
        if 0 not in answers:
            continue
        ends = np.unique(answers[0])
        starts = _starts(row["length"])
        owner = np.searchsorted(starts, ends, side="right") - 1
        low, limit = starts[owner], starts[owner + 1]
        after = np.append(0, ends[:-1] + 1)
        after[1:][owner[1:] != owner[:-1]] = 0
        begins = np.maximum.reduce([after, ends - SPREAD + 1, low])
        stops = np.minimum(ends + WINDOW, limit)
        # The last anchor may stand behind the last window: windows end where the text does.
        cores = np.minimum(ends - begins + 1, stops - begins - WINDOW + 1)
        there = cores > 0
        begins, stops, cores = begins[there], stops[there], cores[there]
        if not len(begins):
            continue
        places, moved, body = _joined(begins, stops, row["body"])
        values = [(begins + moved).astype(np.uint32), (stops - begins).astype(np.uint8), cores.astype(np.uint8)]
        yield _rows(_PHRASES, [(row["block"], places.tobytes(), *(v.tobytes() for v in values), len(cores), body)])


def _phrases_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("begins", np.uint32), ("sizes", np.uint8), ("cores", np.uint8))
    return tuple(np.frombuffer(row[c], k).astype(np.int64) for c, k in kinds)


def _ask_phrases(buckets: int) -> Callable:
    """Hashes of the phrases of a block, of equal ones the first."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                begins, sizes, _ = _phrases_of(row)
                one, two = string_hashes(np.frombuffer(row["body"], np.uint8), begins, sizes)
                order = np.lexsort((two, one))
                new = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
                mine = np.sort(order[new])
                yield _rows(_MEET, _dealt(row["block"], buckets, mine, one[mine], two[mine]))

    return ask


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal phrases the first: blocks and the phrases of a block are numbered by their places."""
    found = _meeting(batches)
    if found is None:
        return
    blocks, codes, one, two, _ = found
    place = np.concatenate([(b << 32) | c.astype(np.int64) for b, c in zip(blocks, codes)])
    order = np.lexsort((place, two, one))
    chosen = np.zeros(len(order), bool)
    chosen[order] = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
    out = _answers(0, blocks, codes, chosen)
    if out is not None:
        yield out


_PIECES = "block long, places binary, windows binary, n_windows int, covers binary, body binary"


def _first_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and windows of phrases at their first places; all other places of a phrase are covered whole."""
    for row, answers in _gathered(batches):
        begins, sizes, cores = _phrases_of(row)
        places = np.frombuffer(row["places"], np.int64).reshape(-1, 2)
        first = np.zeros(len(begins), bool)
        first[answers.get(0, np.zeros(0, np.int64))] = True
        later = _stood(places, begins[~first])
        covers = np.stack([later, later + sizes[~first]], axis=1)
        windows, body = np.zeros((0, 2), np.int64), b""
        if first.any():
            a = begins[first]
            runs, moved, body = _joined(a, a + sizes[first], row["body"])
            places = np.stack([runs[:, 0], _stood(places, runs[:, 1])], axis=1)
            windows = np.stack(_runs(_mask(a + moved, a + moved + cores[first], len(body))), axis=1)
        packed = [v.astype(np.int64).tobytes() for v in (places, windows, covers)]
        n_windows = int((windows[:, 1] - windows[:, 0]).sum())
        yield _rows(_PIECES, [(row["block"], packed[0], packed[1], n_windows, packed[2], body)])


def _wanted(row: dict, answers: dict[int, np.ndarray]) -> np.ndarray:
    """Windows of pieces that hold a gram that occurs twice, of every length looked at so far (the steps of the answers)."""
    n = max(len(row["body"]) - WINDOW + 1, 0)
    ranges = np.frombuffer(row["windows"], np.int64).reshape(-1, 2)
    wanted = _mask(ranges[:, 0], ranges[:, 1], n)
    for gram in LONG_GRAMS[: row["narrowed"]]:
        places = answers.get(gram, np.zeros(0, np.int64))
        wanted &= _mask(np.maximum(places - (WINDOW - gram), 0), places + 1, n)
    return wanted


_STRETCH = "pid long, start long, windows binary, n_windows int, body binary"


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows whose bytes overlap or meet, numbered by place; ``windows`` are pairs (start, end)."""
    for row, answers in _gathered(batches):
        low, high = _runs(_wanted(row, answers))
        if not len(low):
            continue
        places, body = np.frombuffer(row["places"], np.int64).reshape(-1, 2), row["body"]
        run = np.searchsorted(places[:, 0], low, side="right") - 1
        found: list[tuple[int, list[int]]] = []
        before = -1
        for a, end, of in zip(low.tolist(), high.tolist(), run.tolist()):
            while a < end:
                e = min(end, a + STARTS)
                if found and of == before and a < found[-1][1][-1] + found[-1][0] + WINDOW and e - found[-1][0] <= STARTS:
                    found[-1][1].extend([a - found[-1][0], e - found[-1][0]])
                else:
                    found.append((a, [0, e - a]))
                a, before = e, of
        if len(found) >> STRETCH_BITS:
            raise ValueError("more stretches in a block than can be numbered")
        stood = _stood(places, np.array([a for a, _ in found])).tolist()
        pids = range(row["block"] << STRETCH_BITS, (row["block"] << STRETCH_BITS) + len(found))
        rows = []
        for pid, at, (a, pairs) in zip(pids, stood, found):
            size = sum(pairs[1::2]) - sum(pairs[::2])
            rows.append((pid, at, np.array(pairs, np.int32).tobytes(), size, body[a : a + pairs[-1] - 1 + WINDOW]))
        yield _rows(_STRETCH, rows)


# The difference cover ---------------------------------------------------------------------------------------------------


def on_level(level: int, offsets: np.ndarray) -> np.ndarray:
    """Positions of a level: those in the sample of every level before."""
    there = np.ones(len(offsets), bool)
    for k in range(level):
        there &= (offsets // 3**k) % 3 != 0
    return there


def kind(level: int, offsets: np.ndarray) -> np.ndarray:
    """0 for positions that are not in the level's sample, 1 and 2 for those that are."""
    return (offsets // 3**level) % 3


class _Stretches:
    """The stretches of one group in order of their numbers, one after another with zeros between them.

    A position's code is its place in this row of bytes; it is the same on every level.
    """

    def __init__(self, leads: pa.Table):
        leads = leads.sort_by("pid").combine_chunks()
        self.pid = leads.column("pid").to_numpy()
        self.place = leads.column("start").to_numpy()
        data, starts = _bytes(leads.column("body").chunk(0))
        self.length = np.diff(starts)
        self.start = starts[:-1] + ROOM * np.arange(len(self.pid))
        self.size = len(data) + ROOM * len(self.pid)
        self.text = np.zeros(self.size, np.uint8)
        self.text[np.arange(len(data)) + np.repeat(ROOM * np.arange(len(self.pid)), self.length)] = data
        self.row = np.repeat(np.arange(len(self.pid)), self.length)
        self.at = np.arange(len(data)) - np.repeat(starts[:-1], self.length)
        windows = leads.column("windows").to_pylist()
        pairs = np.frombuffer(b"".join(windows), np.int32).reshape(-1, 2)
        owner = np.repeat(np.arange(len(self.pid)), [len(w) // 8 for w in windows])
        edges = np.zeros(self.size + 1, np.int64)
        np.add.at(edges, self.start[owner] + pairs[:, 0], 1)
        np.add.at(edges, self.start[owner] + pairs[:, 1], -1)
        self.wanted = np.cumsum(np.cumsum(edges)[:-1] > 0)  # so many windows start up to each place

    def codes(self, level: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and offsets of the positions of a level at most ``reach`` bytes behind the start of a window."""
        code = self.start[self.row] + self.at
        before = np.where(code > reach, self.wanted[np.maximum(code - reach - 1, 0)], 0)
        there = np.flatnonzero((self.wanted[code] > before) & on_level(level, self.at))
        return code[there], self.at[there]

    def bytes_at(self, code: np.ndarray, n: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, n)[code]

    def window_hashes(self, code: np.ndarray) -> np.ndarray:
        """Fourteen bytes for each window."""
        return np.ascontiguousarray(string_hashes(self.text, code, np.full(len(code), WINDOW)).T).view(np.uint8)[:, :14]


def _numbers(values: np.ndarray) -> bytes:
    """Numbers of 64 bits, all lower halves before all upper ones, which compress."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.int64).view(np.uint32).reshape(-1, 2).T).tobytes()


def _as_numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint32).reshape(2, -1).T).view(np.int64).ravel()


_LEAD = (("pid", "long"), ("start", "long"), ("windows", "binary"), ("body", "binary"))
#: Bytes of text, and numbers, that a position sends on each level besides its code and kind; on level 0 also its hash.
_SENT = {"names": (27, []), 4: (0, ["n0", "n1", "n2", "n3"]), 3: (0, ["n0", "n1", "x", "y"])}
_SENT |= {2: (18, ["x", "y"]), 1: (6, ["x", "y"]), 0: (2, ["x", "y", "order"])}


def _ask_columns(level: int | str) -> list[str]:
    return ["codes", "kinds", "text", "hash", *_SENT[level][1]]


def _group_of(batches: Iterator[pa.RecordBatch]) -> tuple[_Stretches, dict[int, np.ndarray], dict[str, list]] | None:
    """The stretches of the task's group with the ranks that came back, and codes without ranks."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return None
    table = pa.Table.from_batches(tables)
    lead = pc.is_valid(table.column("pid"))
    stretches = _Stretches(table.filter(lead).select(["pid", "start", "windows", "body"]))
    ranks: dict[int, np.ndarray] = {}
    loose: list[np.ndarray] = []
    back = table.filter(pc.invert(lead))
    for level, codes, values in zip(*(back.column(c).to_pylist() for c in ("level", "codes", "ranks"))):
        code = np.frombuffer(codes, np.uint32)
        if values is None:
            loose.append(code)
            continue
        ranks.setdefault(level, np.zeros(stretches.size, np.int64))[code] = _as_numbers(values)
    return stretches, ranks, loose


def _ask(level: int | str, splitters: np.ndarray) -> Callable:
    """From the stretches of a group, with ranks, to one row of packed positions for each bucket."""
    columns = _ask_columns(level)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        group = next((b.column("group")[0].as_py() for b in batches if b.num_rows), None)
        found = _group_of(iter(batches))
        if found is None:
            return
        p, ranks, _ = found
        code, at = p.codes(3 if level == "names" else level, REACH[-1] + 81 if level == "names" else REACH[level])
        if not len(code):
            return
        n_text, numbers = _SENT[level]
        sent: dict[str, np.ndarray] = {}
        of = kind(level, at).astype(np.uint8) if level != "names" else np.zeros(len(at), np.uint8)
        if level == 4:
            sent = {f"n{k}": ranks[3][code + 27 * k] for k in range(4)}
        elif level != "names":
            step, known = 3**level, ranks[level + 1]
            one, two = known[code + step], known[code + 2 * step]
            sent = {"x": np.where(of == 0, one, known[code]), "y": np.where(of == 1, one, two)}
            if level == 3:
                sent |= {"n0": ranks[3][code], "n1": ranks[3][code + step]}
        if level == 0:
            row = np.searchsorted(p.start, code, side="right") - 1
            sent["order"] = (p.pid[row] << PLACE_BITS) | at
        beginnings = np.ascontiguousarray(p.bytes_at(code, BEGINNING)).view(f"S{BEGINNING}").ravel()
        bucket = np.searchsorted(splitters, beginnings, side="right").astype(np.int32)
        del beginnings
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        hashes = p.window_hashes(code) if level == 0 else None
        for mine in np.split(by_bucket, cuts):
            codes = code[mine]
            row = [codes.astype(np.uint32).tobytes(), of[mine].tobytes()]
            row.append(np.ascontiguousarray(p.bytes_at(codes, n_text)).tobytes() if n_text else b"")
            row.append(np.ascontiguousarray(hashes[mine]).tobytes() if level == 0 else b"")
            row += [_numbers(sent[c][mine]) for c in numbers]
            arrays = [pa.array([int(bucket[mine[0]])], pa.int32()), pa.array([group], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([r], pa.binary()) for r in row)], ["bucket", "group", *columns])

    return ask


def _as_words(packed: np.ndarray) -> list[np.ndarray]:
    """Bytes of each position as big-endian words, zeros behind."""
    n, k = packed.shape
    wide = np.zeros((n, -(-k // 8) * 8), np.uint8)
    wide[:, :k] = packed
    return list(wide.view(">u8").astype(np.uint64).T)


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _count_below(mine: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """For each of ``mine`` the number of ``others`` with smaller keys."""
    n = len(mine[0])
    both = [np.concatenate(pair) for pair in zip(mine, others)]
    flag = np.append(np.zeros(n, bool), np.ones(len(others[0]), bool))
    order = _order([*both, flag])
    below = np.empty(len(flag), np.int64)
    below[order] = np.cumsum(flag[order])
    return below[:n]


#: Of the words of two characters, those bits that belong to the first one.
_FIRST = {3: (~0, 0), 2: (~0, 0xFF << 56, 0), 1: (0xFFFFFF << 40,), 0: (0xFF << 56,)}


def merged(level: int, of: np.ndarray, words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of positions of a level: those in the sample come ranked (``x``), the others find their places among them."""
    none, one, two = (np.flatnonzero(of == k) for k in range(3))
    masks = [np.array(m & ((1 << 64) - 1), np.uint64) for m in _FIRST[level]]
    first = [w & m for w, m in zip(words, masks) if m]
    by_one = [w[none] for w in first] + [x[none]]
    none = none[_order(by_one)]
    sample = np.concatenate([one, two])
    sample = sample[np.argsort(x[sample], kind="stable")]
    below = _count_below([w[none] for w in first] + [x[none]], [w[one] for w in first] + [y[one]])
    below += _count_below([w[none] for w in words] + [y[none]], [w[two] for w in words] + [y[two]])
    slots = np.concatenate([2 * below, 2 * np.arange(len(sample)) + 1])
    return np.concatenate([none, sample])[np.argsort(slots, kind="stable")]


def _rank(level: int | str) -> Callable:
    """From the packed rows of one bucket to names or ranks of their positions; on the last level, to covered windows."""
    n_text, numbers = _SENT[level]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        high = np.int64(table.column("bucket")[0].as_py()) << LOCAL_BITS
        groups, codes = table.column("group").to_pylist(), table.column("codes").to_pylist()
        flat = lambda name, kind: np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()])
        number = {c: np.concatenate([_as_numbers(v) for v in table.column(c).to_pylist()]) for c in numbers}
        words = _as_words(flat("text", np.uint8).reshape(-1, n_text)) if n_text else []
        words += [number[c].view(np.uint64) for c in numbers if c.startswith("n")]
        of = flat("kinds", np.uint8)
        hashes = _as_words(flat("hash", np.uint8).reshape(-1, 14)) if level == 0 else []
        del table, tables
        order = _order(words) if level in ("names", 4) else merged(level, of, words, number["x"], number["y"])
        new = np.ones(len(order), bool)
        equal = words if level == "names" else hashes
        if equal:
            new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in equal])
        result = np.empty(len(order), np.int64)
        if level == 0:
            # Stretches are numbered by their places, so of equal windows the one with the least number starts earliest.
            begins = np.flatnonzero(new)
            sizes = np.diff(np.append(begins, len(order)))
            place = number["order"][order]
            result[order] = place != np.repeat(np.minimum.reduceat(place, begins), sizes)
        else:
            result[order] = high + np.cumsum(new)
        low = 0
        for group, packed in zip(groups, codes):
            mine = result[low : low + len(packed) // 4]
            low += len(mine)
            if level == 0:
                kept, values = np.frombuffer(packed, np.uint32)[mine > 0].tobytes(), None
            else:
                kept, values = packed, _numbers(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), pa.array([3 if level == "names" else level], pa.int32())]
                + [pa.array([kept], pa.binary()), pa.array([values], pa.binary())],
                ["group", "level", "codes", "ranks"],
            )

    return rank


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered ranges of the blocks that the stretches of a group come from."""
    found = _group_of(batches)
    if found is None or not found[2]:
        return
    p, _, loose = found
    code = np.sort(np.concatenate(loose).astype(np.int64))
    if not len(code):
        return
    new = np.append(True, code[1:] != code[:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(code)) - 1
    row = np.searchsorted(p.start, code[begins], side="right") - 1
    shift = p.place[row] - p.start[row]
    block = p.pid[row] >> STRETCH_BITS
    ranges = np.stack([code[begins] + shift, code[ends] + shift + WINDOW], axis=1)
    firsts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    packed = [r.tobytes() for r in np.split(ranges, firsts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(block[firsts]), pa.array(packed, pa.binary())], ["block", "codes"])


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings at two windows of some stretches."""
    for batch in batches:
        out = []
        for pid, windows, body in zip(*(batch.column(c).to_pylist() for c in ("pid", "windows", "body"))):
            pairs = np.frombuffer(windows, np.int32).reshape(-1, 2)
            rng = np.random.default_rng(pid)
            for a, b in pairs[rng.integers(0, len(pairs), 2)].tolist():
                at = int(rng.integers(a, b))
                out.append(body[at : at + BEGINNING].ljust(BEGINNING, b"\0"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["beginning"])


def _splitters(stretches: DataFrame, buckets: int, total: int) -> np.ndarray:
    """Beginnings that cut the positions into ``buckets`` about equal parts; PER_BUCKET of them for each come to the driver."""
    every = max(1, total // (buckets * PER_BUCKET // 2))
    some = stretches.where(F.pmod(F.xxhash64("pid"), F.lit(every)) == 0).select("pid", "windows", "body")
    seen = np.array([bytes(r[0]) for r in some.mapInArrow(_beginnings, "beginning binary").collect()], f"S{BEGINNING}")
    seen.sort()
    if not len(seen):
        return seen
    cuts = (np.arange(1, buckets) * len(seen)) // buckets
    return np.unique(seen[cuts])


def covered_windows(stretches: DataFrame, tables: _Tables) -> DataFrame:
    """Blocks and covered ranges, from the windows of stretches that also start earlier, by the suffix array."""
    spark = stretches.sparkSession
    count, windows = stretches.agg(F.count("*"), F.coalesce(F.sum("n_windows"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(windows) // BUCKET_ROWS + 1)
    splitters = _splitters(stretches, parts, int(count))
    nothing = F.lit(None)
    leads = stretches.select(
        F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int").alias("group"),
        "pid",
        "start",
        "windows",
        "body",
        nothing.cast("int").alias("level"),
        nothing.cast("binary").alias("codes"),
        nothing.cast("binary").alias("ranks"),
    )

    def grouped(back: list[DataFrame]) -> DataFrame:
        rows = leads
        for df in back:
            none = [nothing.cast(k).alias(c) for c, k in _LEAD]
            rows = rows.unionByName(df.select("group", *none, "level", "codes", "ranks"))
        return rows.repartitionById(parts, F.col("group"))

    def sort_level(level: int | str, back: list[DataFrame]) -> DataFrame:
        asked = "bucket int, group int, " + ", ".join(f"{c} binary" for c in _ask_columns(level))
        asking = grouped(back).mapInArrow(_ask(level, splitters), asked)
        ranked = "group int, level int, codes binary, ranks binary"
        return asking.repartitionById(parts, F.col("bucket")).mapInArrow(_rank(level), ranked)

    names = tables.write("names", sort_level("names", []))
    ranks = tables.write("ranks4", sort_level(4, [names]))
    for level in (3, 2, 1):
        known = [ranks, names] if level == 3 else [ranks]
        ranks = tables.write(f"ranks{level}", sort_level(level, known))
        tables.drop(f"ranks{level + 1}", *(["names"] if level == 3 else []))
    covered = grouped([sort_level(0, [ranks])])
    out = tables.write("spans", covered.mapInArrow(_spans, "block long, codes binary"))
    tables.drop("ranks1")
    return out


# Documents --------------------------------------------------------------------------------------------------------------


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumn(
        "text_hash", F.xxhash64("body")
    )


class _Dealer:
    """Deals blocks, and what is known of them, to as many tasks as hold TASK_BYTES of text each."""

    def __init__(self, blocks: DataFrame):
        spark = blocks.sparkSession
        last, n_bytes = blocks.agg(F.max("block"), F.sum("n_bytes")).first()
        self.least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.n_bytes = n_bytes or 0
        self.parts = max(self.least, self.n_bytes // TASK_BYTES + 1)
        # Blocks are numbered within their tasks: the first ones of all tasks come first, then the second ones.
        self.tasks = ((last or 0) >> BLOCK_BITS) + 1

    def buckets(self, n: int) -> int:
        return max(self.least, n // MEETING + 1)

    def by_block(self, rows: DataFrame, answers: list[DataFrame]) -> DataFrame:
        held = [c for c in rows.columns if c != "block"]
        every = rows.select("*", F.lit(None).cast("int").alias("step"), F.lit(None).cast("binary").alias("codes"))
        for df in answers:
            none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in held]
            every = every.unionByName(df.select("block", *none, "step", "codes"))
        at, within = F.shiftright("block", BLOCK_BITS), F.col("block").bitwiseAND((1 << BLOCK_BITS) - 1)
        return every.repartitionById(self.parts, F.pmod(at + within * self.tasks, F.lit(self.parts)).cast("int"))


def _met(asked: DataFrame, buckets: int, meet: Callable) -> DataFrame:
    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, _ANSWER)


def first_phrases(blocks: DataFrame, dealer: _Dealer, tables: _Tables) -> DataFrame:
    """Phrases around anchors that occur twice: text and windows of their first places, and what their other places cover."""
    buckets = dealer.buckets(2 * dealer.n_bytes // (SPREAD + 1))
    asked = blocks.select("block", "length", "body").mapInArrow(_ask_anchors(GRAM, buckets), _MEET)
    places = tables.write("places", _met(asked, buckets, _repeated(0)))
    cut = dealer.by_block(blocks.select("block", "length", "body"), [places]).mapInArrow(_cut_phrases, _PHRASES)
    phrases = tables.write("phrases", cut)
    tables.drop("places")
    buckets = dealer.buckets(phrases.agg(F.coalesce(F.sum("n_phrases"), F.lit(0))).first()[0])
    asked = phrases.select("block", "begins", "sizes", "cores", "body").mapInArrow(_ask_phrases(buckets), _MEET)
    firsts = tables.write("firsts", _met(asked, buckets, _first_places))
    pieces = tables.write("pieces", dealer.by_block(phrases, [firsts]).mapInArrow(_first_phrases, _PIECES))
    tables.drop("phrases", "firsts")
    return pieces


def shared_stretches(pieces: DataFrame, dealer: _Dealer, tables: _Tables) -> DataFrame:
    """Stretches of the windows that hold long grams that occur twice."""
    n_windows = pieces.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    held = pieces.select("block", "places", "windows", "body")
    answers: list[DataFrame] = []
    for k, gram in enumerate(LONG_GRAMS):
        buckets = dealer.buckets(2 * n_windows // (WINDOW - gram + 2))
        asked = dealer.by_block(held.withColumn("narrowed", F.lit(k)), answers).mapInArrow(_ask_anchors(gram, buckets), _MEET)
        answers.append(tables.write(f"shared{gram}", _met(asked, buckets, _repeated(gram))))
    cut = dealer.by_block(held.withColumn("narrowed", F.lit(len(LONG_GRAMS))), answers).mapInArrow(_cut_stretches, _STRETCH)
    stretches = tables.write("stretches", cut)
    tables.drop(*(f"shared{gram}" for gram in LONG_GRAMS))
    return stretches


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [span, pa.binary(), pa.string()]
    out: dict[str, list] = {n: [] for n in names}
    size = 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    for row, answers in _gathered(batches):
        body, starts = row["body"], _starts(row["length"])
        ranges = np.concatenate([np.zeros(0, np.int64), *answers.values()]).reshape(-1, 2)
        gone = _mask(ranges[:, 0], ranges[:, 1], len(body))
        before = np.append(0, np.cumsum(gone))
        # A run ends where its text does.
        new = gone & ~np.append(False, gone[:-1])[: len(gone)]
        begins = starts[:-1][starts[:-1] < len(body)]
        new[begins] = gone[begins]
        low = np.flatnonzero(new)
        last = gone & ~np.append(gone[1:], False)[: len(gone)]
        last[begins[1:] - 1] = gone[begins[1:] - 1]
        high = np.flatnonzero(last) + 1
        first_run = np.searchsorted(low, starts).tolist()
        removed = (before[starts[1:]] - before[starts[:-1]]).tolist()
        low, high = low.tolist(), high.tolist()
        ids, copies = (np.frombuffer(row[c], np.int64).tolist() for c in ("doc_id", "copies"))
        edges = starts.tolist()
        for k, (a, e) in enumerate(zip(edges, edges[1:])):
            i, j = first_run[k], first_run[k + 1]
            cuts = [a, *(x for run in zip(low[i:j], high[i:j]) for x in run), e]
            kept = b"".join(body[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            spans = [{"start": x - a, "end": y - a} for x, y in zip(low[i:j], high[i:j])]
            values = (ids[k] if row["has_id"][k] else None, e - a, removed[k], j - i, spans, kept, hashlib.sha256(kept).hexdigest())
            for _ in range(copies[k]):
                for name, value in zip(names, values):
                    out[name].append(value)
                size += len(kept)
                if size >= SLICE_BYTES or len(out["doc_id"]) >= 10_000:
                    yield done()
                    out, size = {n: [] for n in names}, 0
    if out["doc_id"]:
        yield done()


_RESULT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, "
    "kept_sha256 string"
)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans (in bytes), kept (bytes) and kept_sha256."""
    tables = _Tables(df.sparkSession)
    in_order = [F.col("doc_id").asc_nulls_first(), "text_hash"]
    texts = _texts(df, id_col, text_col).repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    blocks = tables.write("blocks", texts.mapInArrow(_pack_blocks(BLOCK_BYTES), _BLOCK))
    dealer = _Dealer(blocks)
    pieces = first_phrases(blocks, dealer, tables)
    stretches = shared_stretches(pieces, dealer, tables)
    spans = covered_windows(stretches, tables)
    tables.drop("stretches")
    later = pieces.select("block", F.lit(0).alias("step"), F.col("covers").alias("codes"))
    partly = spans.select("block", F.lit(1).alias("step"), "codes")
    held = blocks.select("block", "doc_id", "has_id", "length", "copies", "body")
    return dealer.by_block(held, [later, partly]).mapInArrow(_removed, _RESULT)


def repeat_digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
