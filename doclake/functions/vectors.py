"""Vectors: cosine scores, text form, and the plug-in interface for embedders.

Scores are computed on Arrow batches: an ``array<float>`` column arrives as one flat buffer, so a batch is one
matrix-vector product. The rest of the row never leaves the JVM.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column
from doclake.functions.text import prepare_text


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length ``dim`` without NULLs as a float64 matrix, and their positions in the batch."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dim)
    if len(good) < len(vectors):
        vectors = vectors.take(pa.array(good))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(good), dim)
    finite = np.isfinite(rows).all(axis=1)
    return rows[finite], good[finite]


#: Rows turned into one matrix at a time, so that a large Arrow batch of long vectors stays small as float64.
ROWS_AT_ONCE = 1024


def matrix_blocks(vectors: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch as matrices of bounded height, with the positions of their rows in the batch."""
    for low in range(0, len(vectors), ROWS_AT_ONCE):
        rows, at = matrix(vectors.slice(low, ROWS_AT_ONCE), dim)
        if len(at):
            yield rows, at + low


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN and so scores as nothing."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.where(norms == 0, np.nan, norms)


def cosine_to(vector_col, query: Sequence[float]) -> Column:
    """Cosine similarity to one query vector; NULL for a missing, zero or differently sized vector."""
    q = np.asarray(query, dtype=np.float64)
    dim, norm = len(q), float(np.linalg.norm(q))

    def score(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        if norm > 0:
            for rows, at in matrix_blocks(vectors, dim):
                out[at] = unit_rows(rows) @ (q / norm)
        return pa.array(out, from_pandas=True)

    # Declared non-deterministic so that a threshold on the score stays above it: pushed down, the filter would
    # compute every score a second time.
    return F.arrow_udf(score, "double").asNondeterministic()(column(vector_col))


def cosine(a, b) -> Column:
    """Cosine similarity of two vector columns, in the JVM."""
    a, b = column(a), column(b)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_text(c) -> Column:
    """``[v,v,...]``, the form vectors take in text exports."""
    return F.to_json(column(c))


def parse_vector(c) -> Column:
    return F.from_json(column(c), "array<float>")


def float_lists(vectors: list) -> pa.Array:
    """Vectors (or None) as one list array over a single flat buffer."""
    there = [v for v in vectors if v is not None]
    flat = np.concatenate([np.asarray(v, np.float32) for v in there]) if there else np.zeros(0, np.float32)
    ends = np.cumsum([0 if v is None else len(v) for v in vectors], dtype=np.int32)
    absent = pa.array([v is None for v in vectors] + [False])
    offsets = pa.array(np.append(np.int32(0), ends), mask=absent.to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


class Embedder(Protocol):
    """Plug-in: vectors for a column of prepared texts, and for one query text. ``name`` is recorded with the context.

    One that also has ``prepares`` set collapses white space itself and gets the texts as they are.
    """

    name: str
    dim: int

    def vectors(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


class BatchEmbedder:
    """Wraps any function from a list of texts to a list of vectors (or None), called in fixed-size batches.

    A batch whose call fails gives NULL vectors for its own rows only; every vector stays with its text. A text longer than
    the model takes (``max_chars``, None: any length) is embedded window by window; its vector is the mean of theirs, scaled
    to length one. If a window fails, so does the text. White space is collapsed where the texts are handed over.
    """

    prepares = True

    def __init__(
        self,
        call: Callable[[list[str]], Sequence[Sequence[float] | None]],
        dim: int,
        batch: int = 50,
        max_chars: int | None = None,
        name: str = "custom",
    ):
        self.call, self.dim, self.batch, self.max_chars, self.name = call, dim, batch, max_chars, name

    def windows(self, text: str) -> list[str]:
        """The text in pieces that the model takes."""
        if self.max_chars is None or len(text) <= self.max_chars:
            return [text]
        return [text[at : at + self.max_chars] for at in range(0, len(text), self.max_chars)]

    def _safe(self, texts: list[str]) -> list[Sequence[float] | None]:
        try:
            got = list(self.call(texts))
        except Exception:
            return [None] * len(texts)
        return got if len(got) == len(texts) else [None] * len(texts)

    def vectors(self, text: Column) -> Column:
        safe, step, windows = self._safe, self.batch, self.windows
        # Whole calls, so that a slice ends where a call does.
        height = step * max(1, ROWS_AT_ONCE // step)

        def whole(parts: list) -> np.ndarray | None:
            if any(p is None for p in parts):
                return None
            mean = np.mean(np.asarray(parts, dtype=np.float64), axis=0)
            return mean / (np.linalg.norm(mean) or 1.0)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                # Vectors of a slice are handed on before the next one's are made; a batch of them would be large.
                for low in range(0, max(len(texts), 1), height):
                    # ``split`` knows the same white space as ``prepare_text``, at a small part of its cost.
                    rows = [t and " ".join(t.split()) for t in texts.slice(low, height).to_pylist()]
                    pieces = [(i, w) for i, t in enumerate(rows) if t for w in windows(t)]
                    found: list[list] = [[] for _ in rows]
                    for at in range(0, len(pieces), step):
                        part = pieces[at : at + step]
                        for (i, _), vector in zip(part, safe([w for _, w in part]), strict=True):
                            found[i].append(vector)
                    out = [None if not p else p[0] if len(p) == 1 else whole(p) for p in found]
                    yield float_lists(out)

        # The annotation text must resolve to real types for Spark to pick the iterator form.
        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<float>")(text)

    def query(self, text: str) -> list[float]:
        got = self._safe([" ".join(text.split())])[0]
        if got is None:
            raise ValueError("the query text could not be embedded")
        return [float(x) for x in got]


#: Words hashed at a time, about, and the signs of a word.
WORDS_AT_ONCE, WORD_SIGNS = 200_000, 5
_ADLER = 65521
#: Bytes of a word that are hashed together with those of others; longer words are rare.
SHORT = 64
#: What each byte turns a CRC-32 into.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


@lru_cache(maxsize=1024)
def _crc_after(length: int) -> np.ndarray:
    """What a CRC-32 turns into over ``length`` more bytes, apart from these bytes: four tables for the bytes of the CRC."""
    zeros = bytes(length)
    nothing = zlib.crc32(zeros, 0)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ nothing for k in range(32)], np.uint32)
    value = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.array([np.bitwise_xor.reduce(np.where(value == 1, part, 0), axis=1) for part in bits.reshape(4, 8)], np.uint32)


class _Sums:
    """CRC-32, Adler-32 (both halves) and length in bytes of many texts."""

    def __init__(self, crc: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray):
        self.crc, self.low, self.high, self.length = crc, low, high, length

    @classmethod
    def of(cls, texts: list[bytes]) -> _Sums:
        adler = np.array([zlib.adler32(t) for t in texts], np.int64)
        crc = np.array([zlib.crc32(t) for t in texts], np.uint32)
        return cls(crc, adler & 0xFFFF, adler >> 16, np.array([len(t) for t in texts], np.int64))

    @classmethod
    def within(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> _Sums:
        """Of the parts of a row of bytes: the k-th bytes of all parts go into their CRCs at a time."""
        length = ends - starts
        short = np.minimum(length, SHORT)
        order = np.argsort(-short.astype(np.int16), kind="stable")
        at, crc = starts[order], np.full(len(starts), 0xFFFFFFFF, np.uint32)
        reached = np.cumsum(np.bincount(short, minlength=SHORT + 1)[::-1])[::-1]
        for k in range(int(short.max(initial=0))):
            some = crc[: reached[k + 1]]
            some[:] = _CRC[(some ^ data[at[: len(some)] + k]) & 255] ^ some >> 8
        out = np.empty_like(crc)
        out[order] = ~crc
        for i in np.flatnonzero(length > SHORT):
            out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
        # Sums of bytes, and of bytes times their places, up to each place.
        plain = np.append(0, np.cumsum(data, dtype=np.int64))
        placed = np.append(0, np.cumsum(data * np.arange(len(data), dtype=np.int64)))
        total = plain[ends] - plain[starts]
        low = (total + 1) % _ADLER
        high = (length + ends * total - (placed[ends] - placed[starts])) % _ADLER
        return cls(out, low, high, length)

    def after_blank(self) -> _Sums:
        """Of each text with a blank before it."""
        kinds, at = np.unique(self.length, return_inverse=True)
        nothing = np.zeros(len(kinds), np.int64)
        zeros = _Sums(nothing.astype(np.uint32), nothing + 1, nothing, kinds)
        blank = _Sums.of([b" "]).take(nothing).joined(zeros)
        low = (self.low + ord(" ")) % _ADLER
        high = (self.high + self.length * ord(" ") + ord(" ") + 1) % _ADLER
        return _Sums(blank.crc[at] ^ self.crc, low, high, self.length + 1)

    def take(self, at: np.ndarray) -> _Sums:
        return _Sums(self.crc[at], self.low[at], self.high[at], self.length[at])

    def joined(self, other: _Sums) -> _Sums:
        """Of each text followed by the other one."""
        crc = np.empty_like(self.crc)
        brief = other.length.max(initial=0) < 1 << 15
        order = np.argsort(other.length.astype(np.int16) if brief else other.length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(other.length[order])) + 1):
            if len(rows):
                tables, c = _crc_after(int(other.length[rows[0]])), self.crc[rows]
                crc[rows] = tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24] ^ other.crc[rows]
        low = (self.low + other.low - 1) % _ADLER
        high = (self.high + other.high + other.length * (self.low - 1)) % _ADLER
        return _Sums(crc, low, high, self.length + other.length)

    def slots(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and sign of each text in a vector."""
        h = self.crc.astype(np.int64) ^ ((self.high << 16 | self.low) << 7)
        h = ((h & 0xFFFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        return (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(31), 1.0, -1.0)


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """Whether a code point belongs to words, as in the pattern ``\\w``."""
    return np.array([chr(c).isalnum() or c == ord("_") for c in range(0x110000)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and of each word its beginning, end and text."""
    whole = "\n".join(texts)
    encoded = whole.encode()
    data = np.frombuffer(encoded, np.uint8)
    ascii_only = len(encoded) == len(whole)
    codes = data if ascii_only else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    edges = np.diff(_word_signs()[codes].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    if not ascii_only:
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.append(0, np.cumsum(width))
        starts, ends = place[starts], place[ends]
    return data, starts, ends, owner


def _add_terms(out: np.ndarray, rows: list[int], texts: list[str], ngrams: int) -> None:
    """Add the terms of some rows: words, and runs of up to ``ngrams`` of them with blanks between."""
    data, starts, ends, owner = _words(texts)
    if not len(starts):
        return
    single = _Sums.within(data, starts, ends)
    spaced = single.after_blank() if ngrams > 1 else single
    terms = single
    dim, total = out.shape[1], np.zeros((len(texts), out.shape[1]))
    for n in range(1, ngrams + 1):
        if n > 1:
            # Terms that begin at each place; those that would reach into the next text go.
            inside = np.flatnonzero(owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)])
            terms = terms.take(place_of[inside]).joined(spaced.take(inside + n - 1))
        else:
            inside = np.arange(len(starts))
        place_of = np.zeros(len(starts), np.int64)
        place_of[inside] = np.arange(len(inside))
        slots, signs = terms.slots(dim)
        total += np.bincount(owner[inside] * dim + slots, weights=signs, minlength=total.size).reshape(total.shape)
    out[rows] = total


def _hash_batch(texts: list[str], dim: int, ngrams: int) -> np.ndarray:
    out = np.zeros((len(texts), dim))
    rows: list[int] = []
    lowered: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        rows.append(row)
        lowered.append(text.lower())
        held += len(text)
        if held >= WORDS_AT_ONCE * WORD_SIGNS:
            _add_terms(out, rows, lowered, ngrams)
            rows, lowered, held = [], [], 0
    if rows:
        _add_terms(out, rows, lowered, ngrams)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


class HashEmbedder(BatchEmbedder):
    """Local, deterministic default: signed feature hashing of word n-grams (Weinberger et al. 2009), unit length."""

    def __init__(self, dim: int = 3072, ngrams: int = 2, batch: int = 50):
        # A call costs the same for few texts as for some hundred.
        super().__init__(lambda texts: _hash_batch(texts, dim, ngrams), dim, max(batch, 256), name=f"feature-hashing-{dim}-{ngrams}")


def text_embedder() -> Embedder:
    return HashEmbedder(3072, batch=50)


def code_embedder() -> Embedder:
    return HashEmbedder(2048, batch=20)


def embed(c, embedder: Embedder) -> Column:
    """Vector column for a text column: white space collapsed, the whole text embedded in batches."""
    return embedder.vectors(column(c) if getattr(embedder, "prepares", False) else prepare_text(c, None))
