"""Labels, references and fuzzy text similarity."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import property_text


def label(*keys: str) -> Column:
    """The first property that is there, else empty."""
    return F.coalesce(*[property_text(k) for k in keys or ("title", "name", "content")], F.lit(""))


def ref() -> Column:
    return F.concat_ws(":", "kind", F.col("id").cast("string"))


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    """Over UTF-8 bytes; the bonus for up to 4 equal first bytes counts above 0.7."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(n, m) // 2 - 1)
    used = bytearray(m)
    matched = []
    for i, x in enumerate(a):
        j = b.find(x, max(0, i - reach), min(m, i + reach + 1))
        while j >= 0 and used[j]:
            j = b.find(x, j + 1, min(m, i + reach + 1))
        if j >= 0:
            used[j] = 1
            matched.append(x)
    if not matched:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched, (b[j] for j in range(m) if used[j]))) // 2
    k = len(matched)
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def jaro_winkler(column: Column, query: str) -> Column:
    """Similarity to ``query``, once for each distinct value of an Arrow batch; null stays null."""
    target = query.encode()

    @F.pandas_udf("double")
    def similarity(values: pd.Series) -> pd.Series:
        known = {v: jaro_winkler_bytes(v.encode(), target) for v in values.dropna().unique()}
        return values.map(known).astype("float64")

    return similarity(column)


#: Words that a full-text search leaves out (fixed values).
STOP_WORDS = frozenset("""a about above after again against all am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it
its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than
that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who
whom why will with would you your yours yourself yourselves""".split())
_VOWELS = "aeiou"
#: Porter's endings of steps 2, 3 and 4 and what takes their place (fixed values).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
          "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y behind a consonant is a vowel."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in _VOWELS or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of them not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of an English word in lower case by Porter's published rules."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    end = _longest(word, ("sses", "ies", "ss", "s"))
    word = word[: -len(end)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[end] if end else word
    end = _longest(word, ("eed", "ed", "ing"))
    if end == "eed":
        word = word[:-1] if _measure(word[:-3]) else word
    elif end and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, _STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def terms(text: str) -> list[str]:
    """Distinct stems of a query's words, as texts are cut."""
    return sorted({stem(w) for w in re.split("[^a-z0-9]+", text.lower()) if w and w not in STOP_WORDS})


def words(column: Column) -> Column:
    """A text's words, as ``terms`` cuts them, before stems are taken."""
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(sorted(STOP_WORDS)))


def may_have_stem(word: Column, wanted: list[str]) -> Column:
    """False only for words whose stem is none of ``wanted``: the rules change a word's end alone, so a word starts as
    its stem does but for the last two letters. Keeps almost all words out of Python."""
    starts = sorted({w[: max(1, len(w) - 2)] for w in wanted})
    return functools.reduce(lambda a, b: a | b, [word.startswith(s) for s in starts], F.lit(False))


def stems(column: Column) -> Column:
    """The stem of each word, once for each distinct word of an Arrow batch."""

    @F.pandas_udf("string")
    def stemmed(values: pd.Series) -> pd.Series:
        return values.map({w: stem(w) for w in values.unique()})

    return stemmed(column)
