"""Secrets: keyed patterns, and a battery of randomness tests for any other long token.

Column functions only. Base kinds: assign (a name such as ``token`` set to a value of 8 or more characters; the span is the
whole match), access (AKIA keys of 16 or more) and hex (32 or more digits). The method adds kind ``random``: tokens of 20 or
more characters with a letter and a digit. Their encoding is inferred from the characters used (hex, base32, lower-case
alphanumeric, alphanumeric, base64, URL-safe base64), and three tests ask whether the symbols look drawn at random from it:
chi-squared uniformity, the runs test about the middle of the alphabet, and lag-one serial correlation. The p-value is the
Bonferroni combination of the three. A token is dismissed as ordinary text where the Benjamini-Hochberg procedure, run over
all tokens of its length class, rejects randomness at level ALPHA; so of the dismissed tokens of a class at most that share
is expected to be random, whatever mix of lengths the corpus has. What is not dismissed is a span.

Benjamini-Hochberg needs ranks over the corpus. p-values are rounded up to a grid of BINS steps, which keeps the procedure
valid, and counted per class and step; these counts, at most classes times BINS rows, are all that the driver sees.

NULL texts count as empty; an empty table gives an empty result; repeated rows give repeated results, rows without an id
keep it; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored
from doclake.llm.spans import Kind, by_start, digest, listed, with_spans

#: Level of the false-discovery control within a length class.
ALPHA = 0.05
#: p-values are rounded up to exp(-step / STEPS_PER_E), with the last step for all smaller ones.
STEPS_PER_E, BINS = 16, 1024
#: Least lengths of the classes.
LENGTH_CLASSES = (20, 32, 48, 96)

# Patterns and alphabets.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]++"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("[0-9a-f]+", DIGITS + "abcdef"),
    ("[0-9A-F]+", DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
    (".*", UPPER + LOWER + DIGITS + "+/-_"),
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a logistic form that is off by less than 0.0002."""
    c = F.greatest(F.lit(-8.0), F.least(F.lit(20.0), z))
    return 1 / (1 + F.exp(1.5976 * c + 0.07056 * c * c * c))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def uniformity(token: Column, alphabet: Column) -> Column:
    """p-value of the chi-squared statistic against uniform symbols, with its exact mean and variance."""
    n, k = F.char_length(token).cast("double"), F.char_length(alphabet).cast("double")
    letters = F.filter(F.split(alphabet, ""), lambda c: c != "")
    counts = F.transform(letters, lambda c: n - F.char_length(F.replace(token, c, F.lit(""))))
    chi = k / n * _sum(F.transform(counts, lambda c: c * c)) - n
    return upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))


def runs_test(values: Column, k: Column) -> Column:
    """p-value of the number of runs above and below the middle of the alphabet; 0 where one side is empty."""
    above = F.transform(values, lambda v: F.when(2 * v >= k, F.lit(1.0)).otherwise(F.lit(0.0)))

    def p(high: Column) -> Column:
        n = F.size(high).cast("double")
        n1 = _sum(high)
        changes = F.zip_with(F.slice(high, 2, F.size(high)), high, lambda a, b: F.abs(F.coalesce(a, b) - b))
        expected = 2 * n1 * (n - n1) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        return F.when(variance > 0, _two_sided((_sum(changes) + 1 - expected) / F.sqrt(variance))).otherwise(F.lit(0.0))

    return _let(above, p)


def serial_test(values: Column) -> Column:
    """p-value of the correlation of neighbouring symbols; 0 where all symbols are the same."""
    n = F.size(values).cast("double")

    def p(centred: Column) -> Column:
        power = _sum(F.transform(centred, lambda v: v * v))
        following = F.slice(centred, 2, F.size(centred))
        lagged = _sum(F.zip_with(following, centred, lambda a, b: F.coalesce(a, F.lit(0.0)) * b))
        return F.when(power > 0, _two_sided((lagged / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

    return _let(_sum(values) / n, lambda mean: _let(F.transform(values, lambda v: v - mean), p))


def randomness(match: Column, before: Column, after: Column) -> Column:
    """Combined p-value of a token under the hypothesis that its symbols are random; trailing ``=`` is padding."""
    token = F.rtrim(match, F.lit("="))
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(token.rlike("^" + pattern + "$"), F.lit(letters)).otherwise(alphabet)

    def tested(t: Column) -> Column:
        def over(a: Column) -> Column:
            symbols = F.filter(F.split(t, ""), lambda c: c != "")
            values = F.transform(symbols, lambda c: (F.instr(a, c) - 1).cast("double"))

            def p(v: Column) -> Column:
                worst = F.least(uniformity(t, a), runs_test(v, F.char_length(a)), serial_test(v))
                return F.least(F.lit(1.0), 3 * worst)

            return _let(values, p)

        return _let(alphabet, over)

    return _let(token, tested)


def _mentions(text: Column) -> Column:
    small = F.lower(text)
    held = F.lit(False)
    for name in NAMES:
        held = held | F.contains(small, F.lit(name))
    return held


KINDS = [
    Kind("assign", ASSIGN, _mentions, lambda value: F.char_length(value) >= 8, group=2),
    Kind("access", ACCESS, lambda t: F.contains(t, F.lit("AKIA")), lambda m: F.char_length(m) >= 16),
    Kind("hex", HEX, lambda t: t.rlike("[0-9a-f]{32}"), lambda m: F.char_length(m) >= 32),
    Kind(
        "random",
        RANDOM,
        lambda t: t.rlike("[A-Za-z0-9+/_-]{20}"),
        lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
        randomness,
    ),
]
BASE = KINDS[:3]


def _step(p: Column) -> Column:
    smallest = math.exp(-(BINS - 1) / STEPS_PER_E)
    return F.least(F.lit(BINS - 1), F.floor(-F.ln(F.greatest(p, F.lit(smallest))) * STEPS_PER_E)).cast("int")


def _length_class(span: Column) -> Column:
    n = span["end"] - span["start"]
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTH_CLASSES[1:]), F.lit(0))


def rejection_steps(counts: list[tuple[int, int, int]], alpha: float = ALPHA) -> dict[int, int]:
    """Benjamini-Hochberg on rounded p-values: for each class the step from which on randomness is rejected."""
    limits = {}
    for cls in range(len(LENGTH_CLASSES)):
        mine = sorted(((step, n) for c, step, n in counts if c == cls), reverse=True)
        total, seen, limit = sum(n for _, n in mine), 0, BINS
        for step, n in mine:
            seen += n
            if math.exp(-step / STEPS_PER_E) <= alpha * seen / total:
                limit = step
        limits[cls] = limit
    return limits


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per input row: the id and an array of spans for each kind; the score of kind random is its p-value."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = stored(with_spans(rows, KINDS, "_text").drop("_text"), "secret-spans")
    tokens = found.select(F.explode("spans_random").alias("s"))
    counts = tokens.groupBy(_length_class(F.col("s")).alias("c"), _step(F.col("s.score")).alias("b")).count()
    limits = rejection_steps([tuple(r) for r in counts.collect()], alpha)

    def kept(s: Column) -> Column:
        limit = F.lit(BINS)
        for cls, step in limits.items():
            limit = F.when(_length_class(s) == cls, F.lit(step)).otherwise(limit)
        return _step(s["score"]) < limit

    return found.withColumn("spans_random", F.filter("spans_random", kept))


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of a row."""
    found = find_secrets(df, id_col, text_col)
    return found.select(
        F.col(id_col).alias("doc_id"),
        *[F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS],
        digest(by_start(F.concat(*[F.col(f"spans_{k.name}") for k in BASE]))).alias("base_sha256"),
        listed(by_start(F.concat(*[F.col(f"spans_{k.name}") for k in KINDS]))).alias("spans"),
    )
