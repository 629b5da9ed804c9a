"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of word shingles. Texts with equal sets form one class of copies and go on as its representative, the one with
the smallest id; nothing expands copies into pairs. A representative has TREES sequences of DEPTH minhashes; a tree of the
forest holds all sequences in order, and a match in it is a common prefix. The matched prefix is the longest one that a pair
at the threshold shares in some tree with probability RECALL or more. Its length depends on the threshold only: an estimate
over all pairs found is ruled by large groups of very similar texts and says nothing about pairs near the threshold.

Every pair found is verified exactly, once, in the first tree in which it matches. Prefix groups meet in Arrow tasks: a group
of more than BLOCK members is dealt into blocks, and each pair of blocks is a task's work, so no group is ever in one task and
no list of pairs is made. A task returns, for each member, its number of links and the smallest member of its local component;
components across tasks are joined by label propagation.

Words are separated by white space, lower-cased, without punctuation at their ends. A text of fewer words than a shingle has
one shingle of all of them; a text without words has none and no links. NULL counts as empty. Rows without an id come back
with a class of their own (NULL). Rows that repeat an id with the same text count as copies of each other and come back each;
an id with several texts stands for several documents, which hashes of their texts tell apart. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored, unused

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, SEED = 12, 6, 0.995, 41
#: Step between prefix lengths, longest first.
SHORTEN_BY = 2
#: Members of a block, and characters of text that a task works on at a time.
BLOCK, SLICE_CHARS = 192, 4_000_000
# Fixed value: what is cut off at both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|-_/\\+=~`"


# Shingles and signatures -------------------------------------------------------------------------------------------


def _scrambled(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, hashed to 64 bits and sorted, one after another, and where each text's begin."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = pc.list_flatten(lists).dictionary_encode()
    vocabulary = pc.utf8_trim(coded.dictionary, PUNCTUATION)
    empty = pc.equal(vocabulary, "").to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(np.asarray(vocabulary.to_pylist(), dtype=object), categorize=False)
    word = coded.indices.to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = ~empty[word]
    owner, value = owner[real], hashes[word[real]]
    count = np.bincount(owner, minlength=len(texts))
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = len(value)
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            rolled = rolled * factor + value[k : n - words + 1 + k]
        whole = owner[: n - words + 1] == owner[words - 1 :]
        found, of = _scrambled(rolled[whole]), owner[: n - words + 1][whole]
    else:
        found, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (count > 0) & (count < words)
    if short.any():
        first = np.cumsum(count) - count
        folded = np.full(short.sum(), np.uint64(words))
        for k in range(words - 1):
            there = count[short] > k
            folded[there] = folded[there] * factor + value[(first[short] + k)[there]]
        found = np.concatenate([found, _scrambled(folded + np.uint64(1))])
        of = np.concatenate([of, np.flatnonzero(short)])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))).astype(np.int64)


def minhashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes of each text with shingles, zeros for others."""
    rng = np.random.default_rng(SEED)
    n = TREES * DEPTH
    odd = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    mask = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    out = np.zeros((len(starts) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        for j in range(n):
            out[full, j] = np.minimum.reduceat((low ^ mask[j]) * odd[j], starts[full])
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    cuts = np.flatnonzero(np.diff(size // SLICE_CHARS, prepend=0)) if len(size) else np.zeros(0, int)
    bounds = [0, *cuts[cuts > 0].tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(bounds, bounds[1:]) if b > a)


def _sign(words: int):
    names = ["doc_id", "text_hash", "set_key", "n_shingles", "signature"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                shingles, starts = shingle_sets(batch.column("text").slice(a, b - a), words)
                signature = minhashes(shingles, starts)
                size = np.diff(starts)
                raw = shingles.tobytes()
                keys = [
                    hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() if y > x else None
                    for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())
                ]
                marks = [s.tobytes() if n else None for s, n in zip(signature, size)]
                values = [pa.array(keys, pa.binary()), pa.array(size), pa.array(marks, pa.binary())]
                told = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*told, *values], names)

    return sign


# The forest --------------------------------------------------------------------------------------------------------


def prefix_lengths(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """Lengths from DEPTH down; the last is the longest that meets ``recall`` at the threshold, and the one matched."""
    last = next((d for d in range(DEPTH, 0, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)
    return sorted({*range(DEPTH, last, -SHORTEN_BY), last}, reverse=True)


def estimated_recall(seen: int, once: int, twice: int) -> float:
    """Share of the pairs that match in some tree, by Chao's estimator from those that match in one and in two.

    For measurements: it weighs all pairs alike, so it does not bound the recall near the threshold and decides nothing.
    """
    share = (TREES - 1) / TREES
    unseen = share * (once * once / (2 * twice) if twice else once * (once - 1) / 2)
    return seen / (seen + unseen) if seen else 1.0


def _prefixes(depth: int):
    """Prefix keys of each tree: 64 bits to group by, 32 bits of them to compare."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
            marks = marks.reshape(-1, TREES, DEPTH).astype(np.uint64)
            key = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(marks), 1))
            for k in range(depth):
                key = _scrambled(key * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, k])
            short = [row.tobytes() for row in (key >> np.uint64(32)).astype(np.uint32)]
            flat = pa.array(key.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * TREES, pa.int32()), flat)
            values = [batch.column("rep"), batch.column("copies"), lists, pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, ["rep", "copies", "keys", "short"])

    return keys


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of sorted batches, as tables with the places where groups begin; a group cut by batches is joined."""
    rest: pa.Table | None = None

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in by:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        starts = begins(table)
        rest = table.slice(starts[-1])
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def _first_met(short: np.ndarray, tree: int, side: np.ndarray) -> np.ndarray:
    """Pairs (upper matrix) of a group that match in no earlier tree; where there are two sides, only pairs across them."""
    m = len(short)
    pairs = np.triu(np.ones((m, m), bool), 1)
    if side.any():
        pairs &= side[:, None] != side[None, :]
    for t in range(tree):
        pairs &= short[:, None, t] != short[None, :, t]
    return pairs


_MEMBER = "key long, i int, j int, tree int, side int, rep long, copies long, short binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a group that first meet another one in it."""
    for table, starts in _groups(batches, ["key", "i", "j"]):
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint32).reshape(-1, TREES)
        tree, side = table.column("tree").to_numpy(), table.column("side").to_numpy()
        take = []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            if b - a < 2:
                continue
            mine = short[a:b]
            pairs = _first_met(mine, int(tree[a]), side[a:b])
            x, y = np.nonzero(pairs)
            if not len(x):
                continue
            take.append(np.unique(np.concatenate([x, y])) + a)
        if take:
            yield from table.take(pa.array(np.concatenate(take))).combine_chunks().to_batches()


def meetings(reps: DataFrame, depth: int) -> DataFrame:
    """Groups of representatives with a common prefix of ``depth`` in a tree, cut into pairs of blocks."""
    columns = "rep long, copies long, keys array<long>, short binary"
    keyed = stored(reps.select("rep", "copies", "signature").mapInArrow(_prefixes(depth), columns), "prefixes")
    light = keyed.select("rep", F.posexplode("keys").alias("tree", "key"))
    shared = light.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = light.join(shared, "key").join(keyed.select("rep", "copies", "short"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "tree",
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "rep",
            "copies",
            "short",
        )
    )
    # A block meets itself as one side; of two blocks the one with the larger number is side 1.
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stored(grouped.mapInArrow(_meet, _MEMBER), "meetings")


# Verification ------------------------------------------------------------------------------------------------------


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and the sizes of their intersections; large groups by products of membership matrices."""
    x, y = np.nonzero(pairs)
    if len(x) <= 4 * len(sets):
        return x, y, np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code, _ = pd.factorize(np.concatenate(sets))
    often = np.bincount(code) > 1
    owner, code = owner[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)))
    step = 8192
    for low in range(0, int(often.sum()), step):
        a, b = np.searchsorted(code, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], code[a:b] - low] = 1
        common += part @ part.T
    return x, y, common[x, y].astype(np.int64)


def _verify(words: int, threshold: float):
    names = ["rep", "links", "root"]

    def group_links(sets, short, tree, side, copies, reps):
        pairs = _first_met(short, tree, side)
        x, y, common = _overlaps(sets, pairs)
        size = np.array([len(s) for s in sets])
        good = common >= threshold * (size[x] + size[y] - common) - 1e-9
        x, y = x[good], y[good]
        links = np.bincount(x, weights=copies[y], minlength=len(sets)) + np.bincount(y, weights=copies[x], minlength=len(sets))
        root = reps.copy()
        while True:
            before = root.copy()
            np.minimum.at(root, x, before[y])
            np.minimum.at(root, y, root[x])
            if np.array_equal(before, root):
                return np.unique(np.concatenate([x, y])), links, root

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["key", "i", "j"]):
            ends = np.append(starts[1:], table.num_rows)
            # Many small groups are shingled together, up to a number of characters.
            length = pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().cumsum()
            bins = length[ends - 1] // SLICE_CHARS
            for number in np.unique(bins):
                mine = np.flatnonzero(bins == number)
                a, b = starts[mine[0]], ends[mine[-1]]
                part = table.slice(a, b - a).combine_chunks()
                shingles, at = shingle_sets(part.column("text").combine_chunks(), words)
                short = np.frombuffer(b"".join(part.column("short").to_pylist()), np.uint32).reshape(-1, TREES)
                tree, side, copies, reps = (part.column(c).to_numpy() for c in ("tree", "side", "copies", "rep"))
                out = []
                for s, e in zip(starts[mine] - a, ends[mine] - a):
                    sets = [shingles[at[k] : at[k + 1]] for k in range(s, e)]
                    linked, links, root = group_links(sets, short[s:e], int(tree[s]), side[s:e], copies[s:e], reps[s:e])
                    if len(linked):
                        out.append((reps[s:e][linked], links[linked].astype(np.int64), root[linked]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return verify


def components(edges: DataFrame) -> DataFrame:
    """v and label, the smallest vertex of its component, for the vertices of edges (u, v); by label propagation."""
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")).withColumnRenamed("u", "v"), "labels")
    while True:
        heard = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "v").select("v", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = lower.join(jump, "label", "left").select(
            "v", F.least("label", F.coalesce("far", "label")).alias("label"), "old"
        )
        new = stored(new, "labels")
        labels = new.drop("old")
        if new.where("label <> old").isEmpty():
            return labels


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles, text_hash and class_hash of every row.

    class_id is the smallest id of the row's group and class_hash the hash of that document's text, which matters where an id
    has several; n_links is the number of other rows at ``threshold`` or more.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    columns = "doc_id long, text_hash long, set_key binary, n_shingles long, signature binary"
    signed = stored(texts.mapInArrow(_sign(words), columns), "signatures")
    able = signed.where("doc_id is not null and set_key is not null")
    # A representative is a set of shingles under a number of its own, as an id may have several.
    reps = stored(
        able.groupBy("set_key")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("owner"),
            F.count("*").alias("copies"),
            F.first("signature").alias("signature"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "representatives",
    )
    met = meetings(reps, prefix_lengths(threshold, recall)[-1])
    # Texts are dealt out by id once, for all three steps.
    # How many texts meet others has no bound, so this side is never broadcast; the plan is the same at every size.
    owned = met.join(reps.select("rep", "owner.*").hint("merge"), "rep")
    needed = owned.select("doc_id", "text_hash").distinct().hint("merge")
    spoken = texts.join(needed, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    facing = owned.join(spoken, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")
    dealt = facing.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = stored(dealt.mapInArrow(_verify(words, threshold), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    members = labels.withColumnRenamed("v", "rep").join(reps.select("rep", "owner"), "rep")
    heads = members.groupBy("label").agg(F.min("owner").alias("head"))
    classes = (
        reps.select("set_key", "rep", "copies", "owner")
        .join(links, "rep", "left")
        .join(members.join(heads, "label").select("rep", "head"), "rep", "left")
        .select(
            "set_key",
            F.coalesce("head", "owner").alias("head"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    grouped = able.select("doc_id", "text_hash", "set_key", "n_shingles").join(stored(classes, "classes"), "set_key")
    alone = signed.where("doc_id is null or set_key is null")
    return grouped.select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "n_shingles", "text_hash", F.col("head.text_hash").alias("class_hash")
    ).unionByName(
        alone.select(
            "doc_id",
            F.col("doc_id").alias("class_id"),
            F.lit(0).cast("long").alias("n_links"),
            "n_shingles",
            "text_hash",
            F.col("text_hash").alias("class_hash"),
        )
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, that with the smallest id, with all of its columns. Rows without an id stay.

    Of an id with several texts each text stays that is the first of its group.
    """
    own_id, own_hash = (unused(df.columns, n) for n in ("_first", "_hash"))
    groups = near_groups(df, id_col, text_col, **options).where("doc_id = class_id and text_hash = class_hash")
    first = groups.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    has_id = df.where(F.col(id_col).isNotNull())
    marks = {own_id: F.col(id_col).cast("long"), own_hash: F.xxhash64(F.col(text_col).cast("string"))}
    # Only rows that repeat id and text are still there twice.
    stays = has_id.withColumns(marks).join(first, list(marks), "left_semi").dropDuplicates(list(marks)).drop(*marks)
    return stays.select(*df.columns).unionByName(df.where(F.col(id_col).isNull()))
