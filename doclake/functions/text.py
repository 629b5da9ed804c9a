"""Text expressions: preparation for embedding, relevance, lexemes, reply parsing, highlighting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import WORD, column, jvm, let, replace, strip
from doclake.functions.stemming import stem

# English stop words dropped before full-text matching.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now
    """.split()
)
# Fixed value: longest input that text models commonly take.
MAX_TEXT_CHARS = 30_000
# Default keywords for documentation sites, and the URL parts that mark one.
DOC_KEYWORDS = ["docs", "guide", "tutorial", "api", "reference"]
DOC_URL_MARKS = ["docs", "guide", "tutorial", "api"]


def prepare_text(c, max_chars: int | None = MAX_TEXT_CHARS) -> Column:
    """Collapse white space, strip, cut to the longest input a model takes; None cuts nothing."""
    plain = strip(replace(column(c), r"\s+", " "))
    return plain if max_chars is None else F.left(plain, F.lit(max_chars))


def keyword_hits(c, keywords: Iterable[str]) -> Column:
    low = F.lower(column(c))
    return reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in keywords])


def relevance(c, keywords: list[str] | None) -> Column:
    """Share of the keywords found in the text; 1.0 without keywords."""
    if not keywords:
        return F.lit(1.0)
    return F.least(keyword_hits(c, keywords) / F.lit(float(len(keywords))), F.lit(1.0))


def auto_keywords(url, keywords: list[str] | None = None) -> Column:
    """Keywords a crawl of this URL scores pages with; NULL for none."""
    if keywords:
        return F.array(*[F.lit(k) for k in keywords])
    low = F.lower(column(url))
    documentation = reduce(lambda a, b: a | b, [low.contains(m) for m in DOC_URL_MARKS])
    return F.when(documentation, F.array(*[F.lit(k) for k in DOC_KEYWORDS]))


def tokens(c) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(column(c)), F.lit(f"[{WORD}]+"), F.lit(0))


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    return stem(word)


def _stem_batch(lists: pa.Array) -> pa.Array:
    # Stem each distinct word of the batch once.
    words = lists.flatten().dictionary_encode()
    stems = pa.array([_stem(w) for w in words.dictionary.to_pylist()], pa.string())
    offsets = pc.fill_null(lists.offsets, 0)
    first = offsets[0].as_py()
    flat = stems.take(words.indices)
    return pa.ListArray.from_arrays(pc.subtract(offsets, first), flat)


#: Words stemmed at a time; a batch of long texts has many times as many.
WORDS_AT_ONCE = 200_000


def _stem_slices(lists: pa.Array) -> Iterator[pa.Array]:
    """The lists stemmed, some texts of about WORDS_AT_ONCE words in all at a time; a text is never cut."""
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    low, done = 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, side="right")))
        yield _stem_batch(lists.slice(low, high - low))
        low, done = high, int(ends[high - 1])


def stem_udf():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from _stem_slices(lists)

    # The annotation text must resolve to real types for Spark to pick the iterator form.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Declared non-deterministic so that a filter on the stems stays above: pushed down, it would stem every text a second
    # time, in a second Python process of the task.
    return F.arrow_udf(run, "array<string>").asNondeterministic()


def lexemes(c, stop_words: Iterable[str] | None = STOP_WORDS, stemming: bool = False) -> Column:
    """Tokens without stop words, in text order, stemmed on request. Without stemming everything stays in the JVM."""
    words = F.coalesce(tokens(c), F.array().cast("array<string>"))
    if stop_words:
        stops = sorted(stop_words)
        words = F.filter(words, lambda w: ~w.isin(stops))
    return stem_udf()(words) if stemming else words


def query_lexemes(query: str, stop_words: Iterable[str] | None = STOP_WORDS, stemming: bool = False) -> list[str]:
    """Distinct lexemes of a query text, by the same rules."""
    words = [w for w in re.findall(r"\w+", query.lower()) if w not in (stop_words or ())]
    return list(dict.fromkeys(stem(w) if stemming else w for w in words))


def parse_title_summary(reply) -> Column:
    """Title and summary from a model's reply: last ``Title:`` and ``Summary:`` line, too short ones are NULL."""

    def last(lines: Column, prefix: str, shortest: int) -> Column:
        hits = F.filter(lines, lambda x: x.startswith(prefix))
        value = strip(F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 2**31 - 1))
        return let(value, lambda v: F.when(F.length(v) >= shortest, v))

    def both(lines: Column) -> Column:
        return F.struct(last(lines, "Title:", 5).alias("title"), last(lines, "Summary:", 20).alias("summary"))

    return let(F.split(strip(column(reply)), "\n", -1), both)


def highlight(c, query: str, opening: str = "**", closing: str = "**") -> Column:
    """Wrap case-insensitive matches of the query's terms of more than two characters."""
    terms = [re.escape(t) for t in dict.fromkeys(query.lower().split()) if len(t) > 2]
    if not terms:
        return column(c)
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(
        column(c), F.lit(jvm("(" + "|".join(terms) + ")", "i")), F.lit(f"{quote(opening)}$1{quote(closing)}")
    )
