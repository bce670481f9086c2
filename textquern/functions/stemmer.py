"""Suffix stripping after M. F. Porter (1980), with the two later changes bli -> ble and logi -> log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: The longest suffix decides.
_STEP2, _STEP3 = (sorted(rules, key=lambda r: -len(r[0])) for rules in (_STEP2, _STEP3))
_STEP4.sort(key=lambda s: -len(s))


def _kinds(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):  # even if its stem is too short
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str | None) -> str | None:
    if word is None or len(word) <= 2:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _kinds(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    found = next((s for s in _STEP4 if w.endswith(s)), None)
    if found:
        if _measure(w[: -len(found)]) > 1:
            w = w[: -len(found)]
    elif w.endswith("ion") and w[-4:-3] in ("s", "t") and _measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """The terms with their stem; each distinct term is stemmed once, then joined back."""
    stems = terms.select(column).where(F.col(column).isNotNull()).distinct().withColumn("stem", stem_udf(column))
    return terms.join(stems, column, "left")
