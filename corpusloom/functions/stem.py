"""Porter's stemmer (1980) with the later extensions of its author and of common toolkits: short words, irregular forms, `bli`, `fulli`, `logi`, `ied` and `y` after consonants."""

from __future__ import annotations

import re
from functools import lru_cache

# fixed values: irregular forms; endings of each step with what they become. An ending counts where the stem before it has more vowel-consonant runs than the step asks for.
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
_LONG = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
_MIDDLE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _runs(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends as hop or fil do, so that an e was dropped."""
    shape = _shape(stem)
    return shape.endswith("cvc") and stem[-1] not in "wxy" or shape == "vc"


def _first(word: str, endings: list[tuple[str, str]], least: int) -> str:
    """word with the first of the endings that it has replaced, if the stem is long enough."""
    for end, to in endings:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            runs = _runs(word[:-3]) if end == "logi" else _runs(stem)
            return stem + to if runs > least else word
    return word


def _past(word: str) -> str:
    """Without ied, eed, ed or ing."""
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _runs(word[:-3]) > 0 else word
    end = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    stem = word[: -len(end)] if end else ""
    if "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _runs(stem) == 1 and _short(stem) else stem


def _derived(word: str) -> str:
    if word.endswith("alli") and _runs(word[:-4]) > 0:
        return _derived(word[:-2])
    return _first(word, _LONG, 0)


def _bare(word: str) -> str:
    """Without one of the last endings."""
    for end in _LAST:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem if _runs(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else word
    return word


def _tidy(word: str) -> str:
    """Without a last e that the stem does not need, and one l of two."""
    if word.endswith("e"):
        runs = _runs(word[:-1])
        if runs > 1 or runs == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _runs(word[:-1]) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) < 3:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _first(word, _PLURAL, -1)
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _tidy(_bare(_first(_derived(word), _MIDDLE, 0)))
