"""Places of regular expressions in a text, with column functions only.

Spark returns the matches of a pattern but not where they are. Splitting the text by the same pattern gives the pieces
between them, and the lengths of pieces and matches add up to offsets in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import numbered, prefix_sums

#: One place in a text. ``rank`` is the place of its kind in the list of kinds.
SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string,score:double>"


class Kind:
    """A kind of span: a pattern, a cheap exact test whether a text can hold it, and what a match has to pass."""

    def __init__(
        self,
        name: str,
        pattern: str,
        guard: Callable[[Column], Column],
        accept: Callable[[Column], Column],
        score: Callable[[Column, Column, Column], Column] | None = None,
        group: int = 0,
    ):
        self.name, self.pattern, self.guard, self.accept, self.group = name, pattern, guard, accept, group
        #: Of a match, the text before it and the text after it (both up to the neighbouring matches).
        self.score = score or (lambda match, before, after: F.lit(1.0))


def with_spans(df: DataFrame, kinds: list[Kind], text: str) -> DataFrame:
    """``df`` with a column ``spans_<kind>`` (array of SPAN, by start) for each kind. ``text`` must not hold NULL."""
    cut = {}
    for k in kinds:
        held = k.guard(F.col(text))
        cut[f"_p_{k.name}"] = F.when(held, F.split(text, k.pattern, -1))
        cut[f"_m_{k.name}"] = F.when(held, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)))
        if k.group:
            cut[f"_g_{k.name}"] = F.when(held, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group)))
    pieces = df.withColumns(cut)
    lengths = pieces.withColumns({f"_w_{k.name}": _lengths(k) for k in kinds})
    steps = {
        f"_s_{k.name}": F.when(F.col(f"_m_{k.name}").isNotNull(), prefix_sums(F.col(f"_w_{k.name}"))) for k in kinds
    }
    placed = lengths.withColumns(steps)
    return placed.select(*df.columns, *[_spans(k, rank).alias(f"spans_{k.name}") for rank, k in enumerate(kinds)])


def _lengths(kind: Kind) -> Column:
    """From the start of each match to the start of the next: the match before it and the piece between them."""
    match, piece = f"_m_{kind.name}", f"_p_{kind.name}"

    def length(i: Column) -> Column:
        before = F.coalesce(F.char_length(F.get(match, i - 1)), F.lit(0))
        return (before + F.char_length(F.get(piece, i))).cast("long")

    return F.transform(numbered(F.col(match)), length)


def _spans(kind: Kind, rank: int) -> Column:
    match, piece, start = f"_m_{kind.name}", f"_p_{kind.name}", f"_s_{kind.name}"
    tested = f"_g_{kind.name}" if kind.group else match

    def span(i: Column) -> Column:
        score = kind.score(F.get(match, i), F.get(piece, i), F.get(piece, i + 1))
        return F.struct(
            F.get(start, i).alias("start"),
            (F.get(start, i) + F.char_length(F.get(match, i))).alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            score.cast("double").alias("score"),
        )

    good = F.filter(numbered(F.col(match)), lambda i: kind.accept(F.get(tested, i)))
    return F.coalesce(F.transform(good, span), F.array().cast(f"array<{SPAN}>"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column) -> Column:
    return F.sha2(F.encode(listed(spans), "UTF-8"), 256)


def by_start(spans: Column) -> Column:
    """By start, then by kind as listed (start and rank lead the struct, but end stands between them)."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])
