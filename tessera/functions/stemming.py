"""English analysis: stop words, possessives and Porter's stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: words that aren't indexed; fixed values
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: letters and digits, with apostrophes inside
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

_VOWEL = re.compile(r"^[^aeiou]*?[aeiouy]")
#: suffixes and what takes their place where enough is left before them (Porter 1980, steps 2 and 3); fixed values
_STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble"
)
_STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP_4 = tuple("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())


def _shape(word: str) -> str:
    """``v`` and ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and those with other letters than a-z, are their own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP_2, _STEP_3):
        if (s := _longest(word, rules)) and _measure(word[: -len(s)]):
            word = word[: -len(s)] + rules[s]
    if (s := _longest(word, _STEP_4)) and _measure(left := word[: -len(s)]) > 1 and (s != "ion" or left.endswith(("s", "t"))):
        word = left
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or m == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems of words, each distinct word of a batch once."""
    return words.map({w: porter(w) for w in words.dropna().unique()})


def words(text: Column | str) -> Column:
    """Lower-case words of a text in order, without a possessive end."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(w.endswith("'s") | w.endswith("’s"), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))


def analysed(text: str) -> list[tuple[int, str]]:
    """(position, stem) of the words of a query, stop words left out but counted."""
    import regex

    found = [re.sub("['’]s$", "", w) for w in regex.findall(WORD, text.lower())]
    return [(k, porter(w)) for k, w in enumerate(found) if w not in STOP_WORDS]
