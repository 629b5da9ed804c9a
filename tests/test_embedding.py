"""Feature hashing against its plain definition, term by term."""

import re
import zlib

import numpy as np
import pytest

from doclake.functions import vectors as V


def plain(texts, dim, ngrams):
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        words = re.findall(r"\w+", text.lower())
        for n in range(1, ngrams + 1):
            for at in range(len(words) - n + 1):
                term = " ".join(words[at : at + n]).encode()
                h = zlib.crc32(term) ^ (zlib.adler32(term) << 7)
                h = (h * 0x9E3779B1) & 0xFFFFFFFF
                out[row, h % dim] += 1.0 if (h >> 31) & 1 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


TEXTS = ["", "...", "one", "one two", "one two three one two", "Straße É_1 日本 語", "x" * 70_000 + " y" * 300, "a b " * 400]


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_equals_plain_hashing(ngrams, monkeypatch):
    for at_once in (1, 7, 200_000):
        monkeypatch.setattr(V, "WORDS_AT_ONCE", at_once)
        assert np.array_equal(V._hash_batch(TEXTS, 97, ngrams), plain(TEXTS, 97, ngrams))


def test_sums_of_joined_texts():
    left, right = [b"", b"abc", b"\xc3\xa9" * 9000], [b"xyz", b"", b"q" * 70_000]
    joined = V._Sums.of(left).joined(V._Sums.of(right))
    whole = V._Sums.of([a + b for a, b in zip(left, right)])
    for name in ("crc", "low", "high", "length"):
        assert np.array_equal(getattr(joined, name), getattr(whole, name))
