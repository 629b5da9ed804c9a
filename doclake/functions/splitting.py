"""Recursive character splitting of one text into overlapping spans.

The text is cut at the first separator that occurs in it (paragraph, line, blank, character); the separator stays at
the start of the piece behind it. Pieces shorter than the chunk size are merged greedily with overlap, longer ones are
cut again with the remaining separators. Pieces are neighbours in the text, so a chunk is a span and merging is a
search in the sorted list of piece edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Separators in the order they are tried.
SEPARATORS = ("\n\n", "\n", " ", "")


def _marks(codes: np.ndarray, lo: int, hi: int, sep: str) -> np.ndarray:
    """Start offsets of the non-overlapping occurrences of a separator in [lo, hi)."""
    at = np.flatnonzero(codes[lo:hi] == ord(sep[0])) + lo
    if len(sep) == 1 or not len(at):
        return at
    # In a run of the sign every second one begins an occurrence, but for the last of an odd run.
    new = np.append(True, np.diff(at) != 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, sizes)
    return at[(inside % 2 == 0) & (inside + 1 < np.repeat(sizes, sizes))]


def _windows(edges: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy merge of neighbouring pieces, each shorter than ``size``."""
    out, first, last = [], 0, len(edges) - 1
    while last > 0:
        end = int(edges.searchsorted(edges[first] + size, side="right")) - 1
        out.append((int(edges[first]), int(edges[end])))
        if end == last:
            break
        need = max(edges[end] - overlap, edges[end + 1] - size)
        # Never before ``first``: what is needed begins behind it.
        first = min(max(int(edges.searchsorted(need)), first), end)
    return out


def split_spans(text: str, size: int, overlap: int, codes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the chunks, white space at both ends left out."""
    codes = code_points(text) if codes is None else codes
    raw: list[tuple[int, int]] = []

    def cut(lo: int, hi: int, separators: tuple[str, ...]) -> None:
        for depth, sep in enumerate(separators):
            marks = _marks(codes, lo, hi, sep) if sep else np.arange(lo, hi)
            if len(marks) or not sep:
                break
        edges = np.concatenate([[lo], marks[marks > lo], [hi]]) if hi > lo else np.zeros(0, np.int64)
        start = 0
        for k in np.flatnonzero(np.diff(edges) >= size).tolist():
            raw.extend(_windows(edges[start : k + 1], size, overlap))
            if depth + 1 < len(separators):
                cut(int(edges[k]), int(edges[k + 1]), separators[depth + 1 :])
            else:
                raw.append((int(edges[k]), int(edges[k + 1])))
            start = k + 1
        raw.extend(_windows(edges[start:], size, overlap))

    cut(0, len(text), SEPARATORS)
    out = []
    for lo, hi in raw:
        piece = text[lo:hi]
        lead = len(piece) - len(piece.lstrip())
        kept = len(piece.strip())
        if kept:
            out.append((lo + lead, lo + lead + kept))
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


SPAN_TYPE = "array<struct<char_start:int,char_end:int,start_line:int,end_line:int,error:string>>"


def split_batch(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """Chunk spans and line spans for a batch of texts; a text that fails gives one span over all of it."""
    offsets, starts, ends, first, last, errors = [0], [], [], [], [], []
    for text in texts.to_pylist():
        if text is not None:
            codes = code_points(text)
            try:
                spans, error = split_spans(text, size, overlap, codes), None
            except Exception as problem:
                spans, error = [(0, len(text))], str(problem)
            breaks = np.flatnonzero(codes == ord("\n"))
            for lo, hi in spans:
                starts.append(lo)
                ends.append(hi)
                first.append(int(breaks.searchsorted(lo)) + 1)
                last.append(int(breaks.searchsorted(max(hi - 1, lo))) + 1)
                errors.append(error)
        offsets.append(len(starts))
    ints = [pa.array(v, pa.int32()) for v in (starts, ends, first, last)]
    rows = pa.StructArray.from_arrays(
        [*ints, pa.array(errors, pa.string())], ["char_start", "char_end", "start_line", "end_line", "error"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
