"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation's role initials read ``(s?(ua)+)?``. Reading them is an automaton of four states, and repairing is the
cheapest path through it: each row is kept (0), given the role that fits (3) or deleted (4; blank and repeated rows must be),
an empty turn can be inserted before it (3), and a truncated row that stays costs 3 more. From a state only one role can be
inserted or given, so a path is told by its letters D, I, K and R. Of equally cheap paths the one with the ASCII-least letters
counts.

Costs of reaching the four states from the front, and of reaching the end from them, are vectors of four numbers. Both meet in
the middle of the conversation; the cheapest crossing with the least letters is taken and both halves are repaired alike, so
that no table of all rows is held. The front vector carries the order of its letters besides the costs: a path's letters end
with that of a row and hold one such letter a row, so none is the beginning of another and the order at the crossing decides.

Rows are range-partitioned by conversation and turn. A conversation is cut into segments, at the borders of tasks and after
SEGMENT_ROWS rows or SEGMENT_CHARS characters, so one with a third of all rows is the work of many tasks. A segment is summed
up by sixteen costs; the summaries of a conversation meet at crossings as rows do, and then each segment is repaired by itself.
Only the digest of a repaired conversation, a single SHA-256 over all of it, is computed in one task, which reads its pieces in
order and holds one at a time.

NULL conversation ids form a conversation of their own; a NULL id, turn, role or text counts as one space where text is asked
for. Rows go by turn, NULL first, then role, then text; repeated rows are rows. A conversation whose rows are all dropped has
zeros, empty letters and the digest of the empty string. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored

SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = r"[\x20\x09-\x0D]"

# The automaton of (s?(ua)+)?: nothing yet, after s, after u, after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = {0: "u", 1: "u", 2: "a", 3: "u"}
STATES = range(4)
#: Empty turns that end a conversation, by the state before them.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
FULL_ROLE = {"u": "user", "a": "assistant"}
START = ((0, 0), None, None, None)

Path = tuple[int, str]
Vector = tuple[tuple[int, int] | None, ...]


# One conversation ---------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def steps(initial: str, fault: str) -> tuple[tuple[Path | None, ...], ...]:
    """Cost and letters of the best way from each state to each, over one row and the empty turns before it."""
    table: list[list[Path | None]] = [[None] * 4 for _ in STATES]
    for start in STATES:
        state = start
        for inserted in range(4):
            ways = [(DELETE, "D", state)]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                ways.append((REROLE + extra, "R", NEXT[state, FILL[state]]))
                if (state, initial) in NEXT:
                    ways.append((KEEP + extra, "K", NEXT[state, initial]))
            for cost, letter, end in ways:
                path = (inserted * INSERT + cost, "I" * inserted + letter)
                if table[start][end] is None or path < table[start][end]:
                    table[start][end] = path
            state = NEXT[state, FILL[state]]
    return tuple(map(tuple, table))


def _ranked(best: list[tuple | None]) -> Vector:
    """Costs less the least one, and the places of the letters among those of all states."""
    least = min(b[0] for b in best if b)
    order = {key: place for place, key in enumerate(sorted(b[1:] for b in best if b))}
    return tuple((b[0] - least, order[b[1:]]) if b else None for b in best)


@lru_cache(maxsize=1 << 16)
def forward(vector: Vector, code: tuple[str, str]) -> tuple[Vector, int]:
    """The front vector after one more row, and what all its costs have grown by. Few vectors occur, so they are kept."""
    table = steps(*code)
    best: list[tuple | None] = [None] * 4
    for a, b in product(STATES, STATES):
        if vector[a] and table[a][b]:
            key = (vector[a][0] + table[a][b][0], vector[a][1], table[a][b][1])
            if best[b] is None or key < best[b]:
                best[b] = key
    return _ranked(best), min(b[0] for b in best if b)


@lru_cache(maxsize=1 << 16)
def backward(vector: tuple[int | None, ...], code: tuple[str, str]) -> tuple[int | None, ...]:
    """Costs to the end from before a row, less the least one."""
    table = steps(*code)
    best = []
    for a in STATES:
        costs = [table[a][b][0] + vector[b] for b in STATES if table[a][b] and vector[b] is not None]
        best.append(min(costs, default=None))
    least = min(c for c in best if c is not None)
    return tuple(None if c is None else c - least for c in best)


def crossing(front: Vector, back: tuple[int | None, ...]) -> int:
    """The state of the cheapest path, of equally cheap ones that with the least letters in front."""
    return min((front[q][0] + back[q], front[q][1], q) for q in STATES if front[q] and back[q] is not None)[-1]


def _only(state: int) -> Vector:
    return tuple((0, 0) if q == state else None for q in STATES)


def letters(codes: list[tuple[str, str]], start: int, end: int) -> list[str]:
    """The letters of each row on the best path from one state to another, by divide and conquer."""
    out = [""] * len(codes)
    open_parts = [(0, len(codes), start, end)]
    while open_parts:
        low, high, a, b = open_parts.pop()
        if high - low == 1:
            out[low] = steps(*codes[low])[a][b][1]
        elif high > low:
            middle = (low + high) // 2
            front: Vector = _only(a)
            for k in range(low, middle):
                front, _ = forward(front, codes[k])
            back = tuple(0 if q == b else None for q in STATES)
            for k in range(high - 1, middle - 1, -1):
                back = backward(back, codes[k])
            q = crossing(front, back)
            open_parts += [(low, middle, a, q), (middle, high, q, b)]
    return out


def apply_letters(rows: list[tuple[str, str]], path: list[str], state: int) -> list[tuple[str, str]]:
    """The repaired rows (role, text)."""
    out = []
    for (role, text), chosen in zip(rows, path):
        for letter in chosen:
            if letter == "D":
                continue
            if letter == "K":
                out.append((role, text))
                state = NEXT[state, role[:1]]
                continue
            out.append((FULL_ROLE[FILL[state]], text if letter == "R" else ""))
            state = NEXT[state, FILL[state]]
    return out


# Segments -----------------------------------------------------------------------------------------------------------

_SEGMENT = (
    "conv string, part int, segment int, codes array<string>, roles array<string>, texts array<string>, "
    "sums array<int>, places array<int>, first string, last string, illegal long, blank long, duplicate long, truncated long"
)
_LEGAL = ("su", "ua", "au")


def _summary(codes: list[tuple[str, str]]) -> tuple[list[int | None], list[int | None]]:
    """Costs from each state to each over a segment, and the order of their letters."""
    sums, places = [], []
    for a in STATES:
        vector, total = _only(a), 0
        for code in codes:
            vector, grown = forward(vector, code)
            total += grown
        sums += [v[0] + total if v else None for v in vector]
        places += [v[1] if v else None for v in vector]
    return sums, places


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows. A task holds one segment at a time."""
    schema = pa.schema(
        [("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int32())]
        + [(n, pa.list_(pa.string())) for n in ("codes", "roles", "texts")]
        + [(n, pa.list_(pa.int32())) for n in ("sums", "places")]
        + [("first", pa.string()), ("last", pa.string())]
        + [(n, pa.int64()) for n in ("illegal", "blank", "duplicate", "truncated")]
    )
    part, number = TaskContext.get().partitionId(), 0
    conv, rows, size = None, [], 0

    def closed() -> dict:
        codes = [(role[:1] if role[:1] in ("s", "u", "a") else "-", fault) for role, _, fault in rows]
        sums, places = _summary(codes)
        initials = [role[:1] for role, _, _ in rows]
        out = {"conv": conv, "part": part, "segment": number, "sums": sums, "places": places}
        out |= {"codes": [f"{c[0]}{c[1]}" for c in codes], "roles": [r[0] for r in rows], "texts": [r[1] for r in rows]}
        out |= {"first": initials[0], "last": initials[-1]}
        out["illegal"] = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return out | {n: sum(r[2] == n for r in rows) for n in ("blank", "duplicate", "truncated")}

    done, held = [], 0
    for batch in batches:
        for key, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "fault"))):
            if rows and (key != conv or len(rows) >= SEGMENT_ROWS or size >= SEGMENT_CHARS):
                done.append(closed())
                held += size
                number, rows, size = number + 1, [], 0
                if len(done) >= 1000 or held >= 4 * SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, held = [], 0
            conv = key
            rows.append((role, text, fault))
            size += len(text)
    if rows:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


_PLAN = "conv string, part int, segment int, at_start int, at_end int, closing int, cost long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the borders of the segments of each conversation; a row per conversation holds its summaries in order."""
    for batch in batches:
        for row in batch.to_pylist():
            summaries = sorted(row["summaries"], key=lambda s: (s["part"], s["segment"]))
            tables = [[s["sums"][4 * a : 4 * a + 4] for a in STATES] for s in summaries]
            places = [[s["places"][4 * a : 4 * a + 4] for a in STATES] for s in summaries]
            fronts: list[Vector] = [START]
            total = 0
            for table, place in zip(tables, places):
                best: list[tuple | None] = [None] * 4
                for a, b in product(STATES, STATES):
                    if fronts[-1][a] and table[a][b] is not None:
                        key = (fronts[-1][a][0] + table[a][b], fronts[-1][a][1], place[a][b])
                        best[b] = key if best[b] is None else min(best[b], key)
                total += min(b[0] for b in best if b)
                fronts.append(_ranked(best))
            back: tuple[int | None, ...] = tuple(CLOSING[q] * INSERT for q in STATES)
            states = [crossing(fronts[-1], back)]
            cost = total + fronts[-1][states[0]][0] + back[states[0]]
            for table, front in zip(reversed(tables), reversed(fronts[:-1])):
                back = tuple(table[a][states[0]] for a in STATES)
                states.insert(0, crossing(front, back))
            closing = [0] * (len(summaries) - 1) + [CLOSING[states[-1]]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["conv"]] * len(summaries)),
                    pa.array([s["part"] for s in summaries], pa.int32()),
                    pa.array([s["segment"] for s in summaries], pa.int32()),
                    pa.array(states[:-1], pa.int32()),
                    pa.array(states[1:], pa.int32()),
                    pa.array(closing, pa.int32()),
                    pa.array([cost] * len(summaries), pa.int64()),
                ],
                ["conv", "part", "segment", "at_start", "at_end", "closing", "cost"],
            )


_PIECE = "conv string, part int, segment int, audit string, lines long, piece string"


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "part", "segment", "audit", "lines", "piece"]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for row in batch.to_pylist():
            codes = [(c[0], c[1:]) for c in row["codes"]]
            path = letters(codes, row["at_start"], row["at_end"])
            closing = "I" * row["closing"]
            turns = apply_letters(list(zip(row["roles"], row["texts"])), path, row["at_start"])
            turns += apply_letters([("", "")], [closing], row["at_end"])
            for name, value in zip(names, (row["conv"], row["part"], row["segment"])):
                out[name].append(value)
            out["audit"].append("".join(path) + closing)
            out["lines"].append(len(turns))
            out["piece"].append("\n".join(f"{role}:{text}" for role, text in turns))
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order; one digest is open at a time."""
    conv, digest, any_line = None, None, False

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    for batch in batches:
        for key, lines, piece in zip(*(batch.column(c).to_pylist() for c in ("conv", "lines", "piece"))):
            if digest is None or key != conv:
                if digest is not None:
                    yield closed()
                conv, digest, any_line = key, hashlib.sha256(), False
            if lines:
                digest.update((("\n" if any_line else "") + piece).encode())
                any_line = True
    if digest is not None:
        yield closed()


# Tables -------------------------------------------------------------------------------------------------------------


def spaced(column: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(column).cast(kind), F.lit(" "))


def conversation_rows(df: DataFrame) -> DataFrame:
    """conv (the id as text, a space for NULL), conv_id, turn, role and text."""
    return df.select(
        spaced("conv_id").alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with one row in twenty dropped, emptied, cut, repeated or given to the user, by a checksum of its key."""
    kind = F.crc32(F.concat_ws(":", "conv", spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return (
        rows.withColumn("kind", kind)
        .select(
            "conv",
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            F.array_repeat(F.lit(1), times.cast("int")).alias("copies"),
        )
        .select("*", F.posexplode("copies").alias("copy", "_one"))
        .drop("copies", "_one")
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv, illegal, blank, duplicate, truncated, cost, audit and repaired_sha256 of every conversation with rows.

    ``rows`` has conv, turn, role, text (no NULL but in turn) and copy, which tells apart rows that a step repeated.
    """
    digest = F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")).cast("binary"), 256)
    kept = stored(
        rows.select("conv", "turn", "role", "text", "copy", F.monotonically_increasing_id().alias("row")), "turns"
    )
    place = F.struct(F.col("turn").isNotNull(), "turn", "row", "copy")
    # Of rows with equal role and text the first, told by its own number: a key of its own, however often the text occurs.
    first = (
        kept.groupBy("conv", digest.alias("same"))
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("first.row").alias("row"), F.lit(True).alias("is_first"))
    )
    again = (
        kept.groupBy("conv", digest.alias("same")).agg(F.count("*").alias("n")).where("n > 1").select("conv", "same")
    )
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ending = F.right(F.regexp_replace("text", SPACE + r"+\z", ""), F.lit(1))
    marked = (
        kept.withColumn("same", digest)
        .join(again.withColumn("repeated", F.lit(True)), ["conv", "same"], "left")
        .join(first, "row", "left")
        .select(
            "conv",
            "turn",
            "role",
            "text",
            "row",
            "copy",
            F.when(blank, "blank")
            .when(F.col("repeated") & F.col("is_first").isNull(), "duplicate")
            .when(~ending.isin(".", "!", "?"), "truncated")
            .otherwise("")
            .alias("fault"),
        )
    )
    key = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row", "copy"]
    ordered = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    segments = stored(ordered.mapInArrow(_cut, _SEGMENT), "segments")
    light = F.struct("part", "segment", "sums", "places", "first", "last", "illegal", "blank", "duplicate", "truncated")
    whole = segments.groupBy("conv").agg(F.sort_array(F.collect_list(light)).alias("summaries"))
    plan = stored(whole.mapInArrow(_meet, _PLAN), "crossings")
    pieces = stored(
        segments.select("conv", "part", "segment", "codes", "roles", "texts")
        .join(plan, ["conv", "part", "segment"])
        .mapInArrow(_mend, _PIECE),
        "pieces",
    )
    hashed = (
        pieces.select("conv", "part", "segment", "lines", "piece")
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "segment")
        .mapInArrow(_digests, "conv string, repaired_sha256 string")
    )
    audits = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "segment", "audit"))).alias("a"))
    between = F.aggregate(
        F.col("summaries"),
        F.struct(F.lit(None).cast("string").alias("before"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            s["last"].alias("before"),
            (
                acc["n"]
                + F.when(acc["before"].isNotNull() & ~F.concat(acc["before"], s["first"]).isin(*_LEGAL), 1).otherwise(0)
            ).alias("n"),
        ),
    )["n"]

    def total(name: str) -> Column:
        return F.aggregate("summaries", F.lit(0).cast("long"), lambda acc, s: acc + s[name])

    faults = [total(n).alias(n) for n in ("blank", "duplicate", "truncated")]
    return (
        whole.select("conv", *faults, (total("illegal") + between).alias("illegal"))
        .join(plan.groupBy("conv").agg(F.first("cost").alias("cost")), "conv")
        .join(audits.select("conv", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit")), "conv")
        .join(hashed, "conv")
    )


def repair_damaged(df: DataFrame) -> DataFrame:
    """The contract's digest of every original conversation, after its rows were damaged."""
    rows = conversation_rows(df)
    hurt = damaged(rows)
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = hurt.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).alias("gaps"))
    out = rows.select("conv", "conv_id").distinct().join(gaps, "conv", "left").join(repair(hurt), "conv", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        *[F.coalesce(n, zero).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
