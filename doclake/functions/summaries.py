"""Titles and summaries: plug-in interface, a local default, and the acceptance rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column, is_blank, jvm, let, replace, strip
from doclake.functions.text import parse_title_summary

# Shortest text that gets a title, longest text that needs no summary, shortest summary.
MIN_TITLE_INPUT = 50
SUMMARY_TARGET = 600
MIN_SUMMARY = 20


class Summarizer(Protocol):
    """Plug-in: replies of the form ``Title: ...`` / ``Summary: ...``, or plain summaries, for a column of texts."""

    name: str

    def replies(self, text: Column) -> Column: ...

    def summaries(self, text: Column) -> Column: ...


class LeadSummarizer:
    """Local default: the first words make the title, the first sentences the summary. Native expressions only."""

    name = "lead-sentences"

    def __init__(self, title_words: int = 8, sentences: int = 3):
        self.title_words, self.sentences = title_words, sentences

    def _plain(self, text: Column) -> Column:
        return strip(replace(text, r"\s+", " "))

    def summaries(self, text: Column) -> Column:
        return let(strip(text), self._lead)

    def _lead(self, text: Column) -> Column:
        # The pattern ends with the last wanted sentence; the rest of a long text is not looked at.
        lead = F.regexp_extract(text, rf"\A[.!?]*((?:[^.!?]+(?:[.!?]+|$)){{1,{self.sentences}}})", 1)
        pieces = F.regexp_extract_all(self._plain(lead), F.lit(r"[^.!?]+(?:[.!?]+|$)"), F.lit(0))
        return F.array_join(F.transform(pieces, strip), " ")

    def replies(self, text: Column) -> Column:
        words = jvm(rf"\A[^\s]+(?:\s+[^\s]+){{0,{self.title_words - 1}}}")

        def reply(t: Column) -> Column:
            title = self._plain(F.regexp_extract(t, words, 0))
            return F.concat(F.lit("Title: "), title, F.lit("\nSummary: "), self._lead(t))

        return let(strip(text), reply)


class BatchSummarizer:
    """Wraps functions from a list of texts to a list of replies (or None); a failed batch gives NULLs.

    Texts are handed over whole; a function whose model takes less cuts them as suits it.
    """

    def __init__(
        self,
        name: str,
        reply: Callable[[list[str]], Sequence[str | None]],
        summary: Callable[[list[str]], Sequence[str | None]] | None = None,
        batch: int = 20,
    ):
        self.name, self.reply, self.summary, self.batch = name, reply, summary or reply, batch

    def _column(self, call, text: Column) -> Column:
        step = self.batch

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                rows = texts.to_pylist()
                filled = [i for i, t in enumerate(rows) if t]
                out: list = [None] * len(rows)
                for at in range(0, len(filled), step):
                    part = filled[at : at + step]
                    try:
                        got = list(call([rows[i] for i in part]))
                    except Exception:
                        continue
                    if len(got) == len(part):
                        for i, value in zip(part, got, strict=True):
                            out[i] = value
                yield pa.array(out, pa.string())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "string")(text)

    def replies(self, text: Column) -> Column:
        return self._column(self.reply, text)

    def summaries(self, text: Column) -> Column:
        return self._column(self.summary, text)


def title_and_summary(c, summarizer: Summarizer) -> Column:
    """Struct of title, summary and summary_model; texts under fifty characters get none."""
    text = column(c)
    wanted = F.when(F.length(strip(text)) >= MIN_TITLE_INPUT, text)
    parsed = let(summarizer.replies(wanted), parse_title_summary)
    return let(
        parsed,
        lambda p: F.struct(
            p["title"].alias("title"),
            p["summary"].alias("summary"),
            F.when(p["summary"].isNotNull(), F.lit(summarizer.name)).alias("summary_model"),
        ),
    )


def summary_only(c, summarizer: Summarizer) -> Column:
    """Summary for texts longer than the target length; NULL for the rest and for replies that are too short."""
    text = column(c)
    wanted = F.when((F.length(text) > SUMMARY_TARGET) & ~is_blank(text), text)
    return let(strip(summarizer.summaries(wanted)), lambda s: F.when(F.length(s) >= MIN_SUMMARY, s))
