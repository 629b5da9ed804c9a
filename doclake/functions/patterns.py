"""Character classes and strip helpers with the Unicode meaning documentation text needs.

Spark's ``trim`` removes blanks only, and the short regex classes are ASCII by default. The classes below spell the
members out, so one pattern means the same thing in the JVM and in an RE2 engine used to check results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, with and without the newline, and word characters.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = r"\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expand(pattern: str) -> str:
    """Write out ``\\s``, ``\\w`` and ``\\d`` (as classes or class members) in their Unicode meaning."""
    out, in_class, i = [], False, 0
    members = {"s": SPACE, "w": WORD, "d": r"\p{Nd}"}
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            name = pattern[i + 1]
            if name in members:
                out.append(members[name] if in_class else f"[{members[name]}]")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def jvm(pattern: str, flags: str = "") -> str:
    """Pattern for Spark: only ``\\n`` ends a line (``d``), case folding covers Unicode (``u``)."""
    flags = "d" + flags + ("u" if "i" in flags else "")
    return f"(?{flags}){expand(pattern)}"


def re2(pattern: str, flags: str = "") -> str:
    """The same pattern for an RE2 engine."""
    return (f"(?{flags})" if flags else "") + expand(pattern)


def replace(c, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(column(c), F.lit(jvm(pattern, flags)), F.lit(replacement))


#: The members of SPACE as text, for trimming: only the ends of a string are looked at.
SPACE_CHARS = "".join(chr(n) for n in range(0x110000) if chr(n).isspace())


def strip(c) -> Column:
    return F.trim(column(c), F.lit(SPACE_CHARS))


def rstrip(c) -> Column:
    return F.rtrim(column(c), F.lit(SPACE_CHARS))


def is_blank(c) -> Column:
    return F.ltrim(column(c), F.lit(SPACE_CHARS)) == ""


def let(value: Column, body) -> Column:
    """Bind ``value`` once per row and use it several times in ``body``.

    Inside a lambda Catalyst re-evaluates an outer expression for every element; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters of a block of a text that is cut many times.
BLOCK = 4096


def blocks(text) -> Column:
    """The text in blocks, for ``cut``."""
    return F.regexp_extract_all(column(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end (0-based, end exclusive) of a text in blocks.

    ``substring`` counts from the front of the text, so cutting a long one into its parts is quadratic; here only the
    blocks that are touched are looked at.
    """
    first = F.floor(start / BLOCK).cast("int")
    touched = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    near = F.array_join(F.slice(pieces, first + 1, touched), "")
    return F.substring(near, start - first * BLOCK + 1, end - start)


def where_found(text: Column, needles: list[str], step, searched: Column | None = None) -> Column:
    """``step(text)`` where one of the needles occurs, else the text as it is.

    A substring test costs far less than a regular expression that starts an attempt at every character.
    """

    def choose(t: Column) -> Column:
        where = t if searched is None else searched
        found = reduce(lambda a, b: a | b, [where.contains(n) for n in needles])
        return F.when(found, step(t)).otherwise(t)

    return let(text, choose)
