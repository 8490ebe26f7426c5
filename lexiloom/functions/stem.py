"""Porter's stemmer (1980) for index terms, as a Python function and as an Arrow UDF over arrays of words.

Letters are first written as a string of c and v, on which the measure and the other conditions are plain patterns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes in the order in which they are tried, and what they become. In each list the first suffix that
# a word ends with decides, whether or not it may go.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short_end(stem: str) -> bool:
    """consonant, vowel, consonant that is not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lower()
    # plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (m := re.fullmatch("(.*?)(ed|ing)", w, re.S)) and "v" in _shape(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
            w = w if w[-1] in "lsz" else w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (STEP2, STEP3):
        hit = next(((w[: -len(a)], b) for a, b in pairs if w.endswith(a)), None)
        if hit and _measure(hit[0]):
            w = "".join(hit)
    suffix = next((s for s in STEP4 if w.endswith(s)), None)
    if suffix:
        stem = w[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


_stems: dict[str, str] = {}


def _cached(word: str) -> str:
    out = _stems.get(word)
    if out is None:
        if len(_stems) > 500_000:
            _stems.clear()
        out = _stems[word] = porter(word)
    return out


@F.pandas_udf(ArrayType(StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of arrays of words; a worker keeps the stems it has seen, so no word table is joined or shuffled."""
    return words.map(lambda ws: None if ws is None else [_cached(w) for w in ws])
