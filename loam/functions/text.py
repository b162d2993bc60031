"""Text: trimming, token estimates, terms and stems."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that carry no weight in keyword search.
STOPWORDS = (
    "a about an and are as at be been but by can could did do does for from had has have how i if in into is it its may of on or our shall "
    "should so such than that the their them then there these they this to was were what when which who will with would you your"
).split()
#: What a term is, and the shortest.
TERM, SHORTEST = r"[a-z0-9]+(?:[._-][a-z0-9]+)*", 2


def stripped(text: Column) -> Column:
    """Without white space (of Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def starts(parts: Column | str, gap: int) -> Column:
    """Where each of an array's strings starts once they are joined by `gap` characters: running sums of their lengths, in one pass."""

    @F.pandas_udf("array<int>")
    def running(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: None if n is None else np.concatenate(([0], np.cumsum(np.asarray(n, np.int64) + gap)[:-1])).astype(np.int32)[: len(n)])

    return running(F.transform(parts, F.length))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    """Characters by chars_per_token or words, whichever is more; 0 for blank text."""
    t = stripped(text)
    return F.when(F.length(t) == 0, 0).otherwise(F.greatest(F.floor(F.length(t) / chars_per_token), F.size(F.split(t, r"(?U)\s+")))).cast("long")


def raw_terms(text: Column) -> Column:
    """Terms without stemming, in order, with repeats."""
    keep = lambda t: (F.length(t) >= SHORTEST) & ~t.isin(STOPWORDS)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1), keep)


def term_index(term: Column) -> Column:
    return F.crc32(term.cast("binary"))


_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    if m := re.match("gener|commun|arsen", w):
        r1 = m.end()
    else:
        m = re.search(f"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return bool(re.search(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$", w))


#: Fixed values of the published English (Porter 2) stemmer.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def stem(word: str) -> str:
    """The English stemmer of the Snowball project, from its published description."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(f"(^|[{_V}])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].*.s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in set("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(terms: Column) -> Column:
    """Stems of an array of terms; a stem that is too short or a stopword goes."""

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        stop = set(STOPWORDS)

        def one(t: str) -> str:
            if t not in known:
                known[t] = stem(t)
            return known[t]

        return lists.map(lambda ts: None if ts is None else [s for t in ts if len(s := one(t)) >= SHORTEST and s not in stop])

    return stems(terms)


def terms(text: Column, stems: bool = True) -> Column:
    return stemmed(raw_terms(text)) if stems else raw_terms(text)
