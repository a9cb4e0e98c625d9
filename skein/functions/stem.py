"""The Porter stemmer (1980), for distinct terms through Arrow."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix rules of the published algorithm, steps 2 to 4.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple(x.split(":")) if ":" in x else (x, "") for x in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _rules(STEP_2), _rules(STEP_3), _rules(STEP_4)


def _shape(word: str) -> str:
    """c and v for the consonants and vowels of ``word``."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closes(stem: str) -> bool:
    """Whether ``stem`` ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _closes(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((_TWO, 0), (_THREE, 0), (_FOUR, 1)):
        for suffix, other in rules:
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if _measure(stem) > least and (suffix != "ion" or stem.endswith(("s", "t"))):
                    w = stem + other
                break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _closes(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    """Stems of a column of terms."""
    return terms.map(lambda t: None if t is None else porter(t))


def stem_terms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` with ``term_col`` stemmed; every distinct term is stemmed once."""
    stems = terms.select(term_col).distinct().withColumn("__stem", porter_stem(term_col))
    rest = [c for c in terms.columns if c != term_col]
    return terms.join(stems, term_col).select(*rest, F.col("__stem").alias(term_col))
