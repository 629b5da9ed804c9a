"""Porter's suffix-stripping rules for English (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re

# Fixed values from the paper: suffix, replacement.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """Consonants and vowels of a word as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem_part: str) -> int:
    return len(re.findall("v+c+", _shape(stem_part)))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _replace_measured(word: str, table: list[tuple[str, str]]) -> str:
    suffix = _longest(word, [s for s, _ in table])
    if suffix is None:
        return word
    head = word[: -len(suffix)]
    return head + dict(table)[suffix] if _measure(head) > 0 else word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters and non-ASCII words are left alone."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # Plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = _longest(word, ["ed", "ing"])
        if ending and "v" in _shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_consonant(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # Derivational suffixes.
    word = _replace_measured(_replace_measured(word, _STEP2), _STEP3)
    suffix = _longest(word, _STEP4)
    if suffix:
        head = word[: -len(suffix)]
        if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
            word = head
    # Tidy up.
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
