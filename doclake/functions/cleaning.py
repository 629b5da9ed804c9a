"""Markdown cleaning as native expressions; every step is a narrow, JVM-side transformation of one column.

The rules are applied to the text as it stands, inside code fences as well: lines *starting* with "Next", "Back",
"Previous" or "Forward" go, a trailing "copy" is cut from any line, and one- or two-letter lines are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.patterns import column, is_blank, jvm, let, replace, rstrip, strip, where_found

# Text removed anywhere, in this order (flags i and m), each with words one of which it needs to match.
NAVIGATION_PATTERNS = [
    r"(?:^|\n)(?:home|contents?|index|navigation|nav|menu)\s*[:\-]?\s*$",
    r"(?:^|\n)(?:previous|next|back|forward)\s*[:\|\-]?\s*.*$",
    r"(?:^|\n)breadcrumb[s]?\s*[:\-]?.*$",
    r"(?:^|\n)(?:table of contents?|toc)\s*[:\-]?.*$",
    r"(?:^|\n)on this page\s*[:\-]?.*$",
]
NOISE_PATTERNS = [
    r"(?:^|\n)edit on github\s*$",
    r"(?:^|\n)improve this page\s*$",
    r"(?:^|\n)last updated[:\-]?\s*.*$",
    r"(?:^|\n)(?:copyright|©)\s*\d{4}.*$",
    r"(?:^|\n)print this page\s*$",
    r"(?:^|\n)share this.*$",
    r"(?:^|\n)feedback\s*[:\-]?.*$",
    r"(?:^|\n)see also\s*[:\-]?\s*$",
    r"\n?copy\s*$",
]
NEEDED_WORDS = [
    ["home", "content", "index", "nav", "menu"],
    ["previous", "next", "back", "forward"],
    ["breadcrumb"],
    ["table of content", "toc"],
    ["on this page"],
    ["edit on github"],
    ["improve this page"],
    ["last updated"],
    ["copyright", "©"],
    ["print this page"],
    ["share this"],
    ["feedback"],
    ["see also"],
    ["copy"],
]
# A line containing one of these is dropped.
NOISE_PHRASES = [
    "edit this page",
    "improve this page",
    "last modified",
    "last updated",
    "print page",
    "share page",
    "feedback",
    "report issue",
    "edit on github",
    "view source",
    "page source",
    "contribute",
]
# Left-over markup removed after the line pass, in this order, each with text it needs to match.
ARTIFACT_PATTERNS = [
    r"\[!\[.*?\]\(.*?\)\]\(.*?\)",
    r"\[\s*\]",
    r"!\[\s*\]",
    r"\n\s*\|\s*\n",
    r"\n\s*\-{3,}\s*\n",
]
NEEDED_MARKUP = [["[!["], ["["], ["!["], ["|"], ["---"]]
# A line of bars, dashes, arrows and brackets only; a short line of word characters, blanks and dashes.
RULE_LINE = r"^[\s\|\-><\[\]]+$"
SHORT_LINE = r"^[\w\s\-]+$"
# Per-line replacements, in this order, each with text it needs to match.
LINE_RULES = [
    (r"\*{3,}", "**"),
    (r"_{3,}", "__"),
    (r"\[([^\]]*)\]\(\s*\)", "$1"),
    (r"\.{3,}", "..."),
    (r"!{2,}", "!"),
    (r"\?{2,}", "?"),
]
NEEDED_MARKS = [["***"], ["___"], ["]("], ["..."], ["!!"], ["??"]]
# Letters that equal an ASCII letter when case is ignored.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def strip_noise(c) -> Column:
    """Remove navigation and noise passages from the whole text.

    A passage starts a line (or is the word "copy") and ends one, so removing it cannot form a new word: the words a
    pattern needs are looked for in the original text.
    """

    def apply(s: Column) -> Column:
        def step(text: Column, rule: tuple[str, list[str]]) -> Column:
            return where_found(text, rule[1], lambda t: replace(t, rule[0], "", "im"), s["low"])

        return reduce(step, zip(NAVIGATION_PATTERNS + NOISE_PATTERNS, NEEDED_WORDS), s["text"])

    low = F.lower(F.translate(column(c), *FOLDED))
    return let(F.struct(column(c).alias("text"), low.alias("low")), apply)


def is_noise_line(line: Column) -> Column:
    """A phrase of the noise list, a line of rule characters only, or a word of one or two characters."""
    has_phrase = let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in NOISE_PHRASES]))
    is_short = let(strip(line), lambda bare: (F.length(bare) < 3) & bare.rlike(jvm(SHORT_LINE)))
    return has_phrase | line.rlike(jvm(RULE_LINE)) | is_short


def normalize_line(line: Column) -> Column:
    def step(text: Column, rule) -> Column:
        (pattern, new), needed = rule
        return where_found(text, needed, lambda t: replace(t, pattern, new))

    return rstrip(reduce(step, zip(LINE_RULES, NEEDED_MARKS), line))


def _map_lines(c, body) -> Column:
    # array_join leaves NULL elements out, so a NULL line is a dropped line.
    return F.array_join(F.transform(F.split(column(c), "\n", -1), body), "\n")


def drop_noise_lines(c) -> Column:
    """Drop non-blank lines that are only navigation or noise; blank lines stay as they are."""
    return _map_lines(c, lambda x: F.when(is_blank(x) | ~is_noise_line(x), x))


def normalize_lines(c) -> Column:
    """Normalise every line; a line that becomes empty is dropped, a blank one becomes empty."""
    return _map_lines(c, lambda x: F.when(is_blank(x), "").otherwise(F.nullif(normalize_line(x), F.lit(""))))


def collapse_blanks(c) -> Column:
    """Keep a blank line (as an empty one) only directly after a non-blank line."""
    text = _map_lines(c, lambda x: F.when(is_blank(x), "").otherwise(x))
    return _collapse_empty(text)


def _collapse_empty(text: Column) -> Column:
    # Lines are non-blank or empty here, so runs of newlines are runs of empty lines.
    def tail(t: Column) -> Column:
        return F.when(t.endswith("\n\n"), F.concat(F.rtrim(t, F.lit("\n")), F.lit("\n"))).otherwise(t)

    ends = let(F.ltrim(text, F.lit("\n")), tail)
    return where_found(ends, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_lines(c) -> Column:
    """Noise lines, line normalisation and blank collapse in one pass over the lines."""

    def body(x: Column) -> Column:
        return F.when(is_blank(x), "").when(~is_noise_line(x), F.nullif(normalize_line(x), F.lit("")))

    return _collapse_empty(_map_lines(c, body))


def strip_artifacts(c) -> Column:
    def step(text: Column, rule) -> Column:
        return where_found(text, rule[1], lambda t: replace(t, rule[0], ""))

    return reduce(step, zip(ARTIFACT_PATTERNS, NEEDED_MARKUP), column(c))


def normalize_whitespace(c) -> Column:
    """At most one blank line, no trailing blanks, a blank line round headings.

    A heading match takes the newline after it, so the second of two adjacent headings gets no blank line behind it.
    """
    text = replace(c, r"\n\s*\n\s*\n+", "\n\n")
    text = _map_lines(text, rstrip)
    text = where_found(text, ["\n#"], lambda t: replace(t, r"\n(#+\s+.*?)\n", "\n\n$1\n\n"))
    return where_found(text, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_markdown(c) -> Column:
    """Full cleaning; NULL and blank text give ''."""
    text = column(c)
    cleaned = strip(normalize_whitespace(strip_artifacts(clean_lines(strip_noise(text)))))
    return F.when(text.isNull() | is_blank(text), "").otherwise(cleaned)
