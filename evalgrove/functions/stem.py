"""English stems by the Porter2 rules, a word at a time, for texts whose words are compared.

A word has a region R1, what follows the first consonant after a vowel, and R2, the same within R1. Suffixes are taken
off step by step, the longest of a step that fits, if the region or the letters before allow it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
PREFIXES = ("gener", "commun", "arsen")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWELS = "aeiouy"

_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_VOWEL = re.compile(f"[{VOWELS}]")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
#: The end of a short syllable: vowel and consonant after a consonant, or as a whole word.
_SHORT = re.compile(f"([^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    first = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    if first is None:
        found = _REGION.match(word)
        first = found.end() if found else len(word)
    found = _REGION.match(word[first:])
    return first, first + found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest


def _derived(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, STEP2)
    if suffix and len(word) - len(suffix) >= r1:
        rest = word[: -len(suffix)]
        if (suffix != "ogi" or rest.endswith("l")) and (suffix != "li" or rest.endswith(tuple("cdeghkmnrt"))):
            word = rest + STEP2[suffix]
    suffix = _longest(word, STEP3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(word, STEP4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    return word


def _last_letter(word: str, r1: int, r2: int) -> str:
    rest = word[:-1]
    if word.endswith("e") and (len(rest) >= r2 or len(rest) >= r1 and not _SHORT.search(rest)):
        return rest
    return rest if word.endswith("ll") and len(rest) >= r2 else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters are their own, and so is what is not English, mostly."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    marked = ""
    for c in word:  # y at the beginning or after a vowel is a consonant
        marked += "Y" if c == "y" and (not marked or marked[-1] in VOWELS) else c
    r1, r2 = _regions(marked)
    word = re.sub("('s'|'s|')$", "", marked)
    word = _plural(word)
    if word in KEPT:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    return _last_letter(_derived(word, r1, r2), r1, r2).lower()


@F.pandas_udf(StringType())
def stem_words(texts: pd.Series) -> pd.Series:
    """Texts with each word between white space as its stem, one blank between them; null stays null."""
    return texts.map(lambda t: " ".join(map(stem, t.split())), na_action="ignore")
