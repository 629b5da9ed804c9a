"""Code-snippet expressions: validity, preview, language, line statistics, placeholders, match offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column, is_blank, jvm, let, rstrip, strip

# Signs that a piece of text is code.
CODE_INDICATORS = [
    "{",
    "}",
    "(",
    ")",
    "[",
    "]",
    ";",
    "=",
    "->",
    "def ",
    "function",
    "class ",
    "import ",
    "from ",
    "const ",
    "let ",
    "var ",
    "if ",
    "for ",
    "while ",
    "return ",
    "print(",
    "console.log",
    "System.out",
]
# The two active snippet patterns and two optional ones.
FENCE = r"```(\w*)\n(.*?)\n```"
INLINE = r"`([^`\n]+)`"
HTML_BLOCK = r"<pre[^>]*><code[^>]*>(.*?)</code></pre>"
INDENTED = r"(?:^|\n)((?:    .*(?:\n|$))+)"
# How a placeholder is recognised.
PLACEHOLDER = r"\[CODE_SNIPPET:.*?snippet_id=([^\]]+)\]"
MIN_CODE_LENGTH = 10
MIN_INLINE_LENGTH = 20
PREVIEW_LINES = 4
PREVIEW_LENGTH = 200


def is_code(c) -> Column:
    """At least ten characters once stripped, and a sign of code in them."""
    text = column(c)
    found = reduce(lambda a, b: a | b, [text.contains(i) for i in CODE_INDICATORS])
    return F.coalesce((F.length(strip(text)) >= MIN_CODE_LENGTH) & found, F.lit(False))


def preview(c) -> Column:
    """One-line preview from the first meaningful lines, at most 200 characters, quotes escaped."""

    def from_lines(lines: Column) -> Column:
        def meaningful(x: Column) -> Column:
            s = strip(x)
            return (s != "") & ~s.startswith("#") & ~s.startswith("//")

        good = F.slice(F.filter(lines, meaningful), 1, PREVIEW_LINES)
        first = F.filter(F.slice(lines, 1, PREVIEW_LINES), lambda x: ~is_blank(x))
        chosen = let(good, lambda g: F.when(F.size(g) < 2, first).otherwise(g))
        return F.array_join(F.transform(chosen, rstrip), " ")

    def cut(t: Column) -> Column:
        short = F.when(F.length(t) > PREVIEW_LENGTH, F.concat(F.substring(t, 1, PREVIEW_LENGTH - 3), F.lit("...")))
        return F.replace(F.coalesce(short, t), F.lit('"'), F.lit('\\"'))

    return let(let(F.split(column(c), "\n", -1), from_lines), cut)


def guess_language(c) -> Column:
    text = column(c)
    python = text.contains("import ") & (text.contains("def ") | text.contains("class "))
    script = text.contains("function ") | text.contains("const ") | text.contains("let ")
    shell = text.contains("#!/bin/bash") | text.contains("#!/bin/sh")
    return F.when(python, "python").when(script, "javascript").when(shell, "bash").otherwise("text")


def line_count(c) -> Column:
    """Number of lines; nothing counts as no line."""
    text = column(c)
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, "\n", -1)))


def filled_line_count(c) -> Column:
    """Number of lines that are not blank."""
    return F.coalesce(F.size(F.filter(F.split(column(c), "\n", -1), lambda x: ~is_blank(x))), F.lit(0))


def line_stats(c) -> Column:
    text = F.coalesce(column(c), F.lit(""))
    return F.struct(
        line_count(text).alias("lines"),
        filled_line_count(text).alias("filled_lines"),
        F.length(text).alias("chars"),
    )


def placeholder_ids(c) -> Column:
    """Distinct snippet ids named by the placeholders of a text, in order of appearance."""
    found = F.regexp_extract_all(column(c), F.lit(jvm(PLACEHOLDER)), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", "")))


def placeholder(content: Column, snippet: Column, shown: Column | None = None) -> Column:
    """Text that stands for a snippet in the cleaned document; ``shown`` is its preview where that is known."""
    return F.concat(
        F.lit("[CODE_SNIPPET: size="),
        F.length(content).cast("string"),
        F.lit('_chars, preview="'),
        preview(content) if shown is None else shown,
        F.lit('", snippet_id='),
        snippet,
        F.lit("]"),
    )


def running_sums(values: Column) -> Column:
    """Sums of the elements of array<int> up to each, by doubling: n log n steps, where a fold would copy n arrays."""

    def doubled(sums: Column, width: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - width), F.lit(0))).cast("array<int>")

    def scan(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int"))
        widths = F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(widths, v.cast("array<int>"), doubled)

    return let(values, scan)


def matches(c, pattern: str, group: int, flags: str = "") -> Column:
    """All matches of a pattern as array<struct<start_pos, end_pos, original, inner>>, offsets in code points.

    The pieces between matches come from ``split`` with the same pattern, so the offset of a match is the length of
    everything before it.
    """
    text, regex = column(c), jvm(pattern, flags)

    def locate(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        lengths = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("int"))
        return let(
            running_sums(lengths),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).cast("int").alias("start_pos"),
                    F.get(ends, i).alias("end_pos"),
                    m.alias("original"),
                    F.get(s["inner"], i).alias("inner"),
                ),
            ),
        )

    pieces = F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("inner"),
        F.split(text, regex, -1).alias("gaps"),
    )
    return let(pieces, locate)


SNIPPET = (
    "array<struct<snippet_type:string,content:string,start_pos:int,end_pos:int,"
    "char_count:int,line_count:int,original:string>>"
)


def snippets(c, patterns: tuple[str, ...] = ("fence", "inline")) -> Column:
    """Snippets of a text as an array: fenced blocks first, then inline code.

    ``patterns`` may also name "html" and "indented", which are off by default.
    """
    text = column(c)

    def shape(found: Column, before: Column, kind: str, shortest: int, one_line: bool) -> Column:
        def record(m: Column) -> Column:
            def fields(content: Column) -> Column:
                return F.struct(
                    F.lit(kind).alias("snippet_type"),
                    content.alias("content"),
                    (before + m["start_pos"]).alias("start_pos"),
                    (before + m["end_pos"]).alias("end_pos"),
                    F.length(content).alias("char_count"),
                    (F.lit(1) if one_line else F.size(F.split(content, "\n", -1))).alias("line_count"),
                    m["original"].alias("original"),
                )

            return let(strip(m["inner"]), fields)

        keep = lambda s: (s["char_count"] > shortest) & is_code(s["content"])
        return F.filter(F.transform(found, record), keep).cast(SNIPPET)

    known = {
        "fence": (FENCE, 2, "sm", "code_block", 0, False),
        "html": (HTML_BLOCK, 1, "si", "code_block", 0, False),
        "indented": (INDENTED, 1, "m", "code_block", 0, False),
        "inline": (INLINE, 1, "", "inline_code", MIN_INLINE_LENGTH, True),
    }
    empty = F.array().cast(SNIPPET)

    def found(part: Column, before: Column) -> Column:
        shapes = []
        for name in patterns:
            regex, group, flags, kind, shortest, one_line = known[name]
            shapes.append(shape(matches(part, regex, group, flags), before, kind, shortest, one_line))
        return F.concat(*shapes)

    if not set(patterns) <= {"fence", "inline"}:
        return F.when(text.isNotNull(), found(text, F.lit(0))).otherwise(empty)
    # Both patterns begin and end with a backtick: text before the first one and after the last one is not matched.
    before, behind = (F.length(F.substring_index(text, "`", n)) for n in (1, -1))
    outer = F.struct(before.alias("before"), F.substring(text, before + 1, F.length(text) - before - behind).alias("part"))
    inside = let(outer, lambda o: let(o["part"], lambda part: found(part, o["before"])))
    return F.when(text.contains("`"), inside).otherwise(empty)
