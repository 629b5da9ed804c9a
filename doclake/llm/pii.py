"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column functions only; everything about a text is computed in its own row, so nothing is shuffled and no key can be hot.
Base kinds: email, ip (parts at most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15 digits). The method adds
iban (mod-97). A failing match is dropped and not tried again. Scores lie in 0 to 1: a base value of the kind, more when a
word of its context stands within CONTEXT_CHARS of the span, less when a word stands there that speaks against it.

NULL texts count as empty; an empty table gives an empty result; repeated rows give repeated results, rows without an id
keep it; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.spans import Kind, digest, listed, with_spans

#: Code points on either side of a span in which context words count.
CONTEXT_CHARS = 48

# Patterns. Possessive quantifiers and the lookbehinds change no match; they keep a failing search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"

# Words that speak for a kind, base score, words that speak against all of them.
CONTEXT = {
    "email": (0.80, ("mail", "contact", "write to", "reply", "correo", "courriel")),
    "ip": (0.55, ("ip", "host", "server", "address", "client", "login")),
    "card": (0.75, ("card", "visa", "mastercard", "credit", "debit", "payment", "cvv", "tarjeta", "carte", "karte")),
    "phone": (0.70, ("phone", "tel", "call", "mobile", "fax", "contact", "telefon")),
    "iban": (0.85, ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta")),
}
AGAINST = ("example", "version", "sample", "dummy", "test")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn test."""
    turned = F.reverse(digits)
    total = F.lit(0)
    for i in range(19):
        d = F.coalesce(F.try_to_number(F.substring(turned, i + 1, 1), F.lit("9")).cast("int"), F.lit(0))
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def card_ok(match: Column) -> Column:
    digits = _digits(match)
    return F.char_length(digits).between(13, 19) & luhn(digits)


def ip_ok(match: Column) -> Column:
    """Parts at most 255 in value, leading zeros allowed."""
    return F.forall(
        F.split(match, r"\."),
        lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255),
    )


def phone_ok(match: Column) -> Column:
    return F.char_length(_digits(match)).between(9, 15)


def iban_ok(match: Column) -> Column:
    """Length 15 to 34 and remainder 1 of 97, letters read as 10 to 35, the first four characters moved to the end."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        .cast("int"),
    )
    return F.char_length(plain).between(15, 34) & (value == 1)


def _scored(kind: str):
    base, words = CONTEXT[kind]

    def score(match: Column, before: Column, after: Column) -> Column:
        near = F.lower(
            F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(after, F.lit(CONTEXT_CHARS)))
        )
        value = F.lit(base)
        value = value + F.when(near.rlike(r"\b(?:" + "|".join(words) + r")"), F.lit(0.15)).otherwise(F.lit(0.0))
        value = value - F.when(near.rlike(r"\b(?:" + "|".join(AGAINST) + r")"), F.lit(0.25)).otherwise(F.lit(0.0))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)

    return score


KINDS = [
    Kind("email", EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), _scored("email")),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), ip_ok, _scored("ip")),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), card_ok, _scored("card")),
    Kind("phone", PHONE, lambda t: t.rlike(r"\+[0-9]"), phone_ok, _scored("phone")),
    Kind("iban", IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), iban_ok, _scored("iban")),
]
BASE = KINDS[:4]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and an array of spans for each kind."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_spans(rows, KINDS, "_text").drop("_text")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans, all spans, and the highest score of a row."""
    found = find_pii(df, id_col, text_col)
    every = F.concat(*[F.col(f"spans_{k.name}") for k in KINDS])
    base = F.concat(*[F.col(f"spans_{k.name}") for k in BASE])
    counts = [F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    best = F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0))
    return found.select(
        F.col(id_col).alias("doc_id"),
        *counts,
        digest(base).alias("base_sha256"),
        listed(every).alias("spans"),
        best.alias("score"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with every span of a score of ``least`` or more replaced by ``[kind]``; overlaps go to the earlier span."""
    rows = df.select(F.struct(*df.columns).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = with_spans(rows, KINDS, "_text")
    every = F.filter(F.concat(*[F.col(f"spans_{k.name}") for k in KINDS]), lambda s: s["score"] >= least)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        upto = F.substr(F.col("_text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        new = F.struct(F.concat(acc["out"], upto, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    folded = F.aggregate(F.array_sort(every), start, step)
    clean = F.concat(folded["out"], F.substr(F.col("_text"), folded["at"].cast("int") + 1))
    out = found.withColumn("_clean", clean)
    return out.select(*[F.col("_clean").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])

