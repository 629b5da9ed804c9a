"""Conversation repair against a shortest path over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from doclake.llm import conversations
from doclake.llm.conversations import letters, repair_damaged, steps

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"
SHAPE = re.compile(r"(s?(ua)+)?\Z")
DFA = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def best_repair(rows):
    """(cost, audit, repaired) of rows (role, text, fault); all paths, the best per state and row, compared as strings."""
    states = {"": (0, "", ())}

    def insert(states):
        out = dict(states)
        for _ in range(4):
            for state, (cost, audit, turns) in list(out.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in DFA:
                        new = (cost + 3, audit + "I", (*turns, (role, "")))
                        end = DFA[state, role[0]]
                        if end not in out or new[:2] < out[end][:2]:
                            out[end] = new
        return out

    for role, text, fault in rows:
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        # Insertions are tried from every state by themselves, so that no path hides another one with lesser letters.
        for start, path in states.items():
            for state, (cost, audit, turns) in insert({start: path}).items():
                offer(state, (cost + 4, audit + "D", turns))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in DFA:
                    offer(DFA[state, role[:1]], (cost + extra, audit + "K", (*turns, (role, text))))
                for given in ("user", "assistant"):
                    if (state, given[0]) in DFA:
                        offer(DFA[state, given[0]], (cost + 3 + extra, audit + "R", (*turns, (given, text))))
        states = new
    ends = [v for start, path in states.items() for k, v in insert({start: path}).items() if k in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def brute(table):
    out = {}
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        hurt = []
        for turn, role, text in rows:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for turn, role, text in hurt:
            body = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in hurt if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[0][:1] for r in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = best_repair(marked)
        assert SHAPE.match("".join(r[0] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair_damaged(df).collect()}
    assert got == brute(rows)


def some_rows(seed, convs=60, longest=14):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hello.", "What?", "No end", " \t", "", None, "é!", "Done. ", "a" * 3000 + "."]
    rows = []
    for conv in [*range(convs), None]:
        for k in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([k, k, k, None, k + 3]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:15]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, some_rows(seed))


def test_cut_over_tasks_and_segments(spark, monkeypatch):
    """A conversation with most of the rows, in segments of a few rows and over several tasks."""
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 3)
    rng = random.Random(3)
    hot = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["A.", "B", f"text {k}."])) for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, hot + [r for r in some_rows(4, 20) if r[0] != 7])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_divide_and_conquer_finds_the_least_letters():
    rng = random.Random(9)
    for _ in range(300):
        codes = [(rng.choice("sua-"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(1, 9))]
        best = {0: (0, "")}
        for code in codes:
            new = {}
            for a, (cost, text) in best.items():
                for b, step in enumerate(steps(*code)[a]):
                    if step and (b not in new or (cost + step[0], text + step[1]) < new[b]):
                        new[b] = (cost + step[0], text + step[1])
            best = new
        for end, (_, text) in best.items():
            assert "".join(letters(codes, 0, end)) == text


def test_empty_and_all_dropped(spark):
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    check(spark, [(dropped, 1, "user", "Gone.")])
