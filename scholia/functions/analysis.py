"""Text analysis for the index: tokens, possessives, stop words, accent folding, Porter stems.

``analyze`` is the one definition; ``analyze_column`` runs it on Arrow batches, and
``plain_tokens`` is the JVM-side variant (lower-case ASCII letters and digits, no stems) for
corpora where that is enough.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The English stop words of the index.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_TOKEN = re.compile(r"[^\W_]+(?:['’.][^\W\d_]+|[.,](?<=\d.)\d+)*")
_POSSESSIVE = re.compile(r"['’][sS]$")


def plain_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def fold(word: str) -> str:
    """Letters without accents, as far as they decompose, and a few that do not."""
    if word.isascii():
        return word
    out = "".join(ch for ch in unicodedata.normalize("NFKD", word) if not unicodedata.combining(ch))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ı", "i")):
        out = out.replace(a, b)
    return out


def _vowels(w: str) -> str:
    """A word as v and c: y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _vowels(stem)))


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return len(w) > 2 and _vowels(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: The suffix tables of Porter's algorithm (1980).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _vowels(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _vowels(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _vowels(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, by in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + by
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def analyze(text: str | None) -> list[str]:
    """The index terms of a text, in order."""
    out = []
    for token in _TOKEN.findall(text or ""):
        word = _POSSESSIVE.sub("", token).lower()
        if word and word not in STOP_WORDS:
            out.append(stem(fold(word)))
    return out


@F.pandas_udf(ArrayType(StringType()))
def analyze_column(text: pd.Series) -> pd.Series:
    """analyze() over Arrow batches."""
    return text.map(analyze)
