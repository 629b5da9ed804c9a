"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words (a run of U+2581 marks and what follows up to the next run), because no piece holds a mark after
another character. The substrings of each distinct word, up to the longest piece, are looked up in the piece table; those
found are the edges of the word's lattice. The lattice is then folded into the word's pieces, and the words of a text give
its ids.

Two forms of the lattice are here. ``viterbi_words`` is relational: substrings are exploded, joined to the piece table,
grouped by word and folded by ``aggregate`` into the path with the largest sum of scores, which is how a unigram model
segments. A merge model keeps merge ranks as scores, and the best sum is another segmentation than the merges give. ``encode``
therefore folds the same edges in merge order (best score first, then leftmost) and agrees with the model's own library id by
id. It builds lattices for the distinct words of a slice of texts with numpy, inside Arrow tasks; nothing is shuffled. README
tells why words are not joined back to their texts.

Characters outside the piece table become byte pieces. A NULL text counts as empty and has no ids; U+2581 in a text decodes as
a blank, as in the library; an empty table gives an empty result; repeated rows give repeated results; further columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters worked on at a time inside a task, words of more characters than LONG one by one.
SLICE_CHARS, LONG = 2_000_000, 32
MARK = "▁"
_NONE = np.int32(-1)
_FAR = np.int64(1) << 40


@dataclass(frozen=True)
class PieceTable:
    """Pieces of a model in order of score, best first, and the ids of byte pieces."""

    pieces: list[str]
    ids: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    size: int


def load_pieces(path: str = MODEL) -> PieceTable:
    """The piece table of a model file; read on the driver only, its size is the model's vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = np.array([i for i in range(size) if model.is_byte(i)], np.int32)
    plain = [
        i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    if len(byte_ids) != 256 or any(MARK in model.id_to_piece(i).lstrip(MARK) for i in plain):
        raise ValueError("a model with byte pieces and with marks only at the start of pieces is needed")
    plain.sort(key=lambda i: (-model.get_score(i), i))
    scores = np.array([model.get_score(i) for i in plain])
    ranks = np.concatenate([[0], np.cumsum(np.diff(scores) != 0)]).astype(np.int64)
    return PieceTable([model.id_to_piece(i) for i in plain], np.array(plain, np.int32), ranks, byte_ids, size)


def _scrambled(values: np.ndarray, seed: int) -> np.ndarray:
    x = values.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Hash:
    """Hashes of any substring of an array of code points, from running sums modulo 2**64."""

    FACTORS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
    _powers: dict[tuple[int, bool], np.ndarray] = {}

    def __init__(self, points: np.ndarray, which: int):
        n, factor = len(points) + 1, self.FACTORS[which]
        self.down = self.powers(which, True, n)
        terms = _scrambled(points, which + 1) * self.powers(which, False, n)[:-1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.factor = factor

    @classmethod
    def powers(cls, which: int, inverse: bool, n: int) -> np.ndarray:
        have = cls._powers.get((which, inverse))
        if have is None or len(have) < n:
            base = cls.FACTORS[which]
            base = pow(base, -1, 1 << 64) if inverse else base
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            have = cls._powers[(which, inverse)] = np.cumprod(steps, dtype=np.uint64)
        return have[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Codec:
    """Encoder and decoder of one task."""

    FILTER_BITS = 20

    def __init__(self, table: PieceTable):
        self.table = table
        self.longest = max(map(len, table.pieces))
        lengths = np.array([len(p) for p in table.pieces])
        ends = np.cumsum(lengths)
        points = _code_points("".join(table.pieces))
        keys = _Hash(points, 0).of(ends - lengths, ends)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys, self.checks = keys[self.order], _Hash(points, 1).of(ends - lengths, ends)
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self._slot(keys)] = True
        self.single = np.full(0x110000, _NONE, np.int32)
        one = np.flatnonzero(lengths == 1)
        self.single[[ord(table.pieces[i]) for i in one]] = one
        self.by_text = {p: i for i, p in enumerate(table.pieces)}
        # What each id stands for, in bytes.
        spelled = [b""] * table.size
        for i, piece in zip(table.ids, table.pieces):
            spelled[i] = piece.replace(MARK, " ").encode()
        for value, i in enumerate(table.byte_ids):
            spelled[i] = bytes([value])
        self.spelled_len = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)

    def _edges(self, hashes: tuple[_Hash, _Hash], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Join of substrings to the piece table: the place of the piece, or -1."""
        keys = hashes[0].of(start, end)
        out = np.full(keys.shape, _NONE, np.int32)
        maybe = np.nonzero(self.filter[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        piece = self.order[at]
        good = (self.keys[at] == keys[maybe]) & (self.checks[piece] == hashes[1].of(start[maybe], end[maybe]))
        out[tuple(m[good] for m in maybe)] = piece[good]
        return out

    def _fold(self, points, hashes, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of ``n`` known characters: places in the table, padded with -1, and their number."""
        w = len(starts)
        edge = np.full((w, n, min(n, self.longest) + 1), _NONE, np.int32)
        edge[:, :, 1] = self.single[points[starts[:, None] + np.arange(n)]]
        for length in range(2, min(n, self.longest) + 1):
            begin = starts[:, None] + np.arange(n - length + 1)
            edge[:, : n - length + 1, length] = self._edges(hashes, begin, begin + length)
        bounds = np.tile(np.arange(n + 1, dtype=np.int64), (w, 1))
        count = np.full(w, n, np.int64)
        ranks = np.append(self.table.ranks, _FAR)
        live = np.arange(w)
        while len(live) and n > 1:
            b, c = bounds[live], count[live]
            most = int(c.max())
            if most < 2:
                break
            left, right = b[:, : most - 1], b[:, 2 : most + 1]
            span = right - left
            inside = (np.arange(2, most + 1) <= c[:, None]) & (span < edge.shape[2])
            found = np.where(inside, edge[live[:, None], np.minimum(left, n - 1), np.where(inside, span, 0)], _NONE)
            rank = ranks[found]
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(live)), best] < _FAR
            live, b, best = live[going], b[going], best[going]
            drop = np.arange(n)[None, :] > best[:, None]
            bounds[live, :n] = np.where(drop, b[:, 1:], b[:, :-1])
            count[live] -= 1
        at = np.arange(n)
        used = at < count[:, None]
        left = np.where(used, bounds[:, :-1], 0)
        span = np.where(used, bounds[:, 1:] - bounds[:, :-1], 0)
        return np.where(used, edge[np.arange(w)[:, None], left, span], _NONE), count

    def _long(self, word: str) -> list[int]:
        """The same fold for one word of any length, with a heap."""
        symbols = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if i >= 0 and j < len(symbols) and (text := symbols[i] + symbols[j]) in self.by_text:
                heapq.heappush(heap, (int(self.table.ranks[self.by_text[text]]), i, text))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, text = heapq.heappop(heap)
            if not symbols[i] or (j := after[i]) >= len(symbols) or symbols[i] + symbols[j] != text:
                continue
            symbols[i], symbols[j], after[i] = text, "", after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.by_text[s] for s in symbols if s]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        marked = [MARK + t if t else "" for t in texts]
        points = _code_points("".join(marked)).copy()
        lengths = np.array([len(t) for t in marked], np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points[points == 32] = ord(MARK)
        mark, strange = points == ord(MARK), self.single[points] < 0
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[1:] |= strange[:-1]
        opens |= strange
        opens[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(points)))
        hashes = (_Hash(points, 0), _Hash(points, 1))
        pair = [h.of(start, start + size) for h in hashes]
        word, first = pd.factorize(pair[0] ^ (pair[1] << np.uint64(1)) ^ size.astype(np.uint64))
        lead = np.zeros(len(first), np.int64)
        lead[word[::-1]] = np.arange(len(word))[::-1]
        same = (pair[0] == pair[0][lead[word]]) & (pair[1] == pair[1][lead[word]]) & (size == size[lead[word]])
        if not same.all():  # words that share a hash and are not the same stand for themselves
            odd = np.flatnonzero(~same)
            word[odd] = np.arange(len(lead), len(lead) + len(odd))
            lead = np.append(lead, odd)
        ids, count = self._words(points, hashes, start[lead], size[lead], strange[start[lead]])
        offset = np.cumsum(count) - count
        per_word = count[word]
        flat = ids[np.repeat(offset[word] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())]
        text_of = np.repeat(np.arange(len(texts)), lengths)[start]
        return flat, np.bincount(text_of, weights=per_word, minlength=len(texts)).astype(np.int64)

    def _words(self, points, hashes, start, size, strange) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size[~strange]):
            group = np.flatnonzero((size == n) & ~strange)
            if n > LONG:
                for k in group:
                    text = points[start[k] : start[k] + n].tobytes().decode("utf-32-le")
                    found = self.table.ids[self._long(text)]
                    count[k] = len(found)
                    parts.append((np.full(len(found), k), found))
                continue
            step = max(1, 2_000_000 // int(n * n))
            for chunk in np.array_split(group, -(-len(group) // step)):
                pieces, count[chunk] = self._fold(points, hashes, start[chunk], int(n))
                used = pieces >= 0
                parts.append((np.repeat(chunk, count[chunk]), self.table.ids[pieces[used]]))
        for k in np.flatnonzero(strange):
            found = self.table.byte_ids[list(chr(points[start[k]]).encode())]
            count[k] = len(found)
            parts.append((np.full(len(found), k), found))
        owner = np.concatenate([p[0] for p in parts])
        return np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")], count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Texts of ids; the blank that the first mark stands for is left out."""
        lengths = self.spelled_len[ids]
        before = np.cumsum(lengths) - lengths
        buffer = self.spelled[np.repeat(self.spelled_at[ids] - before, lengths) + np.arange(lengths.sum())]
        last = np.cumsum(count)
        ends = np.append(before, lengths.sum())[last]
        first = np.append(0, ends[:-1])
        raw = buffer.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(first, ends)]
        return pa.array(texts, pa.string())


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= SLICE_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, round_trip (whether decoding the ids gives the text back) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(table)  # as large as the model's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, count = codec.encode(texts[a:b])
                plain = pc.replace_substring(pc.fill_null(batch.column(1).slice(a, b - a), ""), MARK, " ")
                values = [
                    batch.column(0).slice(a, b - a),
                    pc.cast(pc.utf8_length(plain), pa.int64()),
                    pa.array(count),
                    _lists(ids, count),
                    pc.equal(codec.decode(ids, count), plain),
                ]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_chars", "n_pieces", "ids", "round_trip"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids array<int>, round_trip boolean")


def decode(df: DataFrame, table: PieceTable, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; NULL ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            lists = batch.column(1)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = codec.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


# Relational form ----------------------------------------------------------------------------------------------------


def piece_frame(spark: SparkSession, table: PieceTable, scores: list[float] | None = None) -> DataFrame:
    """The piece table as rows (piece, id, score); scores default to minus the rank."""
    values = scores or [-float(r) for r in table.ranks]
    rows = [(p, int(i), float(s)) for p, i, s in zip(table.pieces, table.ids, values)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def viterbi_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -1e9) -> DataFrame:
    """word and ids: for each distinct word the path of its lattice with the largest sum of scores.

    ``words`` has a column ``word``. A character without a piece gives id -1 at the score ``unknown``. Of equal sums the path
    whose last piece is longest wins. The piece table is broadcast; its size is the model's.
    """
    distinct = words.select("word").where("word is not null and word <> ''").groupBy("word").count()
    cut = distinct.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("begin"))
    ends = F.sequence(F.col("begin"), F.least(F.col("begin") + longest - 1, F.char_length("word")))
    exploded = cut.select("word", "begin", F.explode(ends).alias("end"))
    keyed = exploded.withColumn("piece", F.substr("word", F.col("begin"), F.col("end") - F.col("begin") + 1))
    joined = keyed.join(F.broadcast(pieces), "piece", "left")
    edges = joined.where("id is not null or begin = end").select(
        "word",
        F.struct(
            "end",
            "begin",
            F.coalesce("id", F.lit(-1)).alias("id"),
            F.coalesce("score", F.lit(unknown)).alias("score"),
        ).alias("edge"),
    )
    lattices = edges.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    node = "struct<score:double,ids:array<int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")).cast(node))

    def step(best: Column, edge: Column) -> Column:
        origin = F.get(best, edge["begin"] - 1)
        path = F.struct(
            (origin["score"] + edge["score"]).alias("score"), F.concat(origin["ids"], F.array(edge["id"])).alias("ids")
        )
        known = F.size(best) > edge["end"]
        better = path["score"] > F.get(best, edge["end"])["score"]
        return (
            F.when(~known, F.concat(best, F.array(path)))
            .when(better, F.concat(F.slice(best, F.lit(1), edge["end"]), F.array(path)))
            .otherwise(best)
        )

    return lattices.select("word", F.element_at(F.aggregate("edges", start, step), -1)["ids"].alias("ids"))


def words_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Words of texts as ``encode`` cuts them, for texts without strange characters."""
    marked = F.concat(F.lit(MARK), F.replace(F.col(text_col), F.lit(" "), F.lit(MARK)))
    return df.select(F.explode(F.split(marked, f"(?<=[^{MARK}])(?={MARK})", -1)).alias("word"))
