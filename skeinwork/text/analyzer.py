"""Text analysis for ranking: ASCII lower case, alphanumeric runs, stop words, suffix stemming."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how if in into is it its just may more no not of on or our she so some such than that the their them then there these they this to up was we were what when which who will with would you".split()
)
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+").findall
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


@lru_cache(200_000)
def stem(w: str) -> str:
    """Porter's suffix rules; a rule whose measure test fails lets later rules of steps 2 and 3 try."""
    if len(w) <= 2:
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
            if w.endswith(suffix) and _vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, to in rules:
            if w.endswith(suffix) and _measure(w[: -len(suffix)]) > 0:
                w = w[: -len(suffix)] + to
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def analyze(text: str | None, stemming: bool = True, stop_words: bool = True) -> list[str]:
    """Terms of a text in order; bytes above ASCII belong to terms as they are."""
    out = []
    for raw in _TOKEN((text or "").encode()):
        term = raw.lower().decode("utf-8", "replace")
        if stop_words and term in STOP_WORDS:
            continue
        if stemming:
            term = stem(term)
            if stop_words and term in STOP_WORDS:
                continue
        out.append(term)
    return out


def terms(text: Column, stop_words: bool = True) -> Column:
    """The tokens of a text column without stop words, by built-in functions; see :func:`stems`."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*sorted(STOP_WORDS))) if stop_words else found


def stems(token: Column) -> Column:
    """The stem of each token, in Arrow batches; meant for distinct tokens."""

    @F.pandas_udf("string")
    def run(tokens):
        return tokens.map(stem)

    return run(token)
