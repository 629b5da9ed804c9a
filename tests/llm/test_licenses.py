"""Licence notices against a brute-force walk over words."""

import math
import random
import re

import pytest

from doclake.llm.licenses import BASE, BASE_SCORE, NOTICES, RAREST, SHARE, SLACK, find_licenses

PHRASES = [phrase.split(" ") for phrase, _ in BASE]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words = words_of(text)
    places = [(i, k) for i in range(len(words)) for k, p in enumerate(PHRASES) if words[i : i + len(p)] == p]
    labels = ",".join(sorted({BASE[k][1] for _, k in places}))
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    parts = ["cc", "by", "CC BY", "all rights reserved", "All Rights", "reserved.", "General Public License", "public",
             "license", "é", "K", "2.0", "\n", ";", "ALL", "rights", "cc-by cc by", "word", "İ"]
    out = ["", None, "cc by", "cc by cc by", "all rights reserved all rights reserved", "😀 cc\x00by", "x" * 30000]
    out += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    out.append("filler words here. Licensed under CC BY-NC 4.0. " * 2000)
    return out


def test_base_columns_match_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.doc_id: r for r in find_licenses(df).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_notices_are_found_by_place_and_key_phrase(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "version", "under", "free", "zeta"]) for _ in range(n))
    rows = [(i, f"{filler(30)} {words} {filler(30)}") for i, (_, words, _) in enumerate(NOTICES)]
    rows += [(100 + i, filler(80)) for i in range(50)]
    rows.append((200, "license mit released the under"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_licenses(df).collect()}
    for i, (label, _, _) in enumerate(NOTICES):
        assert label in got[i].labels.split(","), label
        assert got[i].score > 0.5
    assert all(got[i].labels == "" and got[i].score == 0 for i in got if i >= 100)


def matcher(texts):
    """Labels and score of each text, by trying every start of every template."""
    lists = [words_of(t) for t in texts]
    lexicon = {w for _, words, _ in NOTICES for w in words.split(" ")}
    counts = {w: sum(w in set(x) for x in lists) for w in lexicon}
    idf = {w: math.log((len(texts) + 1) / (counts[w] + 1)) + 1e-9 for w in lexicon}
    out = []
    for words, text in zip(lists, texts):
        labels, best = set(), 0.0
        for label, notice, phrase in NOTICES:
            template, key = notice.split(" "), phrase.split(" ")
            rare = sorted(set(template), key=lambda w: (-idf[w], w))[:RAREST]
            for start in range(1 - len(template), len(words)):
                inside = range(max(0, -start), min(len(template), len(words) - start))
                agree = {template[i] for i in inside if words[start + i] == template[i]} & set(rare)
                if len(agree) < SHARE * len(rare):
                    continue
                piece = words[max(0, start - SLACK) : start + len(template) + SLACK]
                if any(piece[k : k + len(key)] == key for k in range(len(piece))):
                    labels.add(label)
                    best = max(best, sum(idf[w] for w in agree) / sum(idf[w] for w in rare))
        n_base, base = brute(text)[1], brute(text)[4]
        labels |= set(base.split(",")) - {""}
        out.append((",".join(sorted(labels)), round(max(best, BASE_SCORE if n_base else 0.0), 6)))
    return out


def test_labels_and_scores_match_brute_force(spark):
    rng = random.Random(11)
    every = sorted({w for _, words, _ in NOTICES for w in words.split(" ")})
    texts = ["", None]
    for k in range(260):
        label, notice, phrase = NOTICES[k % len(NOTICES)]
        words = notice.split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind > 0)] = [rng.choice(every)] * (kind < 2)
        around = [[rng.choice(every) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        texts.append(" ".join([*around[0], *words, *around[1]]))
        texts.append(" ".join([*around[1], phrase, *around[0]]))  # the phrase in another body
    got = {r.doc_id: (r.labels, r.score) for r in find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = matcher(texts)
    assert [got[i][0] for i in range(len(texts))] == [w[0] for w in want]
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_more_than_a_phrase_search(spark):
    """A key phrase in another body is no notice; a notice with some words changed, put in or left out is one."""
    notice = next(words for label, words, _ in NOTICES if label == "mit" and len(words) > 800)
    changed = notice.replace("furnished", "given").replace("sublicense", "relicense").replace("whom the", "whom this same")
    other = "he said permission is hereby granted free of charge and went on to speak of the weather " * 3
    rows = [(0, notice), (1, changed), (2, other), (3, notice.replace("hereby ", "")), (4, "zeta " * 200)]
    got = {r.doc_id: r.labels for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "", 4: ""}


def test_a_text_of_many_notices_has_all_of_their_labels(spark):
    rows = [(0, " zeta ".join(words for _, words, _ in NOTICES))]
    rows += [(100 + 10 * k + i, words) for k, words in enumerate(x for _, x, _ in NOTICES) for i in range(k % 10)]
    rows += [(1000 + i, "released under the mit license and licensed under cc by 4 0") for i in range(40)]
    got = {r.doc_id: r for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[0].labels.split(",")) >= {label for label, _, _ in NOTICES}
    assert got[0].score == 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (1, "cc by"), (1, "cc by")], "doc_id long, text string")
    assert find_licenses(df).count() == 3
    assert find_licenses(df.limit(0)).count() == 0
