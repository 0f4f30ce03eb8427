"""English stems of words (the published Porter2 rules), for the text half of search."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: English words that a text index leaves out.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
#: Words with a stem of their own, and words that stay once a plural "s" is gone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
STAYING = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_AFTER = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_VOWEL = re.compile("[aeiouy]")


def _ending(word: str, endings: dict[str, str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-cased word; words with other characters than a to z keep their form."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    whole = re.match("gener|commun|arsen", word) or _AFTER.search(word)
    r1 = whole.end() if whole else len(word)
    inner = _AFTER.search(word, r1)
    r2 = inner.end() if inner else len(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in STAYING:
        return word

    cut = _ending(word, dict.fromkeys(("eed", "eedly", "ed", "edly", "ing", "ingly"), ""))
    if cut in ("eed", "eedly"):
        if len(word) - len(cut) >= r1:
            word = word[: len(word) - len(cut)] + "ee"
    elif cut and _VOWEL.search(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    for endings, region in ((SECOND, r1), (THIRD, r1), (FOURTH, r2)):
        cut = _ending(word, endings)
        if not cut or len(word) - len(cut) < region:
            continue
        before = word[: -len(cut)]
        if (cut == "ogi" and not before.endswith("l")) or (cut == "li" and not re.search("[cdeghkmnrt]$", before)):
            continue
        if (cut == "ative" and len(before) < r2) or (cut == "ion" and not before.endswith(("s", "t"))):
            continue
        word = before + endings[cut]

    n = len(word) - 1
    if word.endswith("e") and (n >= r2 or (n >= r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and n >= r2:
        word = word[:-1]
    return word.lower()


@F.arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    return pa.array([row and [None if w is None or w in STOP_WORDS else stem(w) for w in row] for row in words.to_pylist()], pa.list_(pa.string()))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stems(text: Column) -> Column:
    """Stem of each word of a text in its place; null where the word is one that an index leaves out."""
    return _stems(words(text))
