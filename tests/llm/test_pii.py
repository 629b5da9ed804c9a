"""Personal data against Python's regular expressions and checksums."""

import hashlib
import random
import re

import pytest

from doclake.llm.pii import find_pii, pii_digest, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    ]


def card(rng, n):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a@b.com_x@y.org", "x@y", "@", "é.z+1@mail-1.example.co", "1.2.3.4.5", "256.1.1.1", "007.0255.1.1", "9.9.9",
             "+1 (017) 555-7713", "+44", "+12 3", "😀", "\n", " ", "-", "word", "IBAN DE89 3704 0044 0532 0130 00",
             "GB82WEST12345698765432", "GB83WEST12345698765432", "12345678901234567890123", "+1+2+3 456 789 012"]
    out = ["", None, "a@b.c", "@@@a@b.c@d.e", "z" * 40000 + "@", "call +1 (017) 555-7713 now", "+" * 500]
    for _ in range(300):
        made = [rng.choice(parts) if rng.random() < 0.7 else card(rng, rng.randint(12, 20)) for _ in range(rng.randint(1, 14))]
        out.append(rng.choice(["", " ", "-"]).join(made))
    out.append(" ".join("mail a@b.org or " + card(rng, 16) for _ in range(2000)))
    return out


def test_base_spans_match_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "id")
    got = {r.doc_id: r for r in pii_digest(df, "id").collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert got[i].spans.startswith(joined)


def test_iban_and_scores(spark):
    df = spark.createDataFrame(
        [(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "GB83WEST12345698765432"), (3, "example.test a@b.org"), (4, "mail a@b.org")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in pii_digest(df).collect()}
    assert got[1].spans == "iban:5:32" and got[1].score == 1.0
    assert got[2].n_iban == 0
    assert got[3].score < got[4].score


def test_redaction_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", "s"), (None, None, None), (1, "mail a@b.org now", "s")],
                               "doc_id long, text string, spans_email string")
    assert sorted(r.text for r in redact(df).collect()) == ["", "mail [email] now", "mail [email] now"]
    assert redact(df).columns == df.columns
    assert pii_digest(df).count() == 3
    assert find_pii(df.limit(0)).count() == 0
