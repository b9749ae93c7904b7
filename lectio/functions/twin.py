"""Plain Python forms of the analysis: for query texts, and as what the column forms are tested against."""

from __future__ import annotations

import re

from .rules import LAST_SUFFIXES, DOUBLE_SUFFIXES, NOUN_SUFFIXES, SEPARATORS, STOP_WORDS

_SPLIT = re.compile(SEPARATORS)
_STOP = frozenset(STOP_WORDS)


def _shape(word: str) -> str:
    """``v`` and ``c`` for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """Number of changes from consonants to vowels."""
    return _shape(word).count("cv")


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of one token; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, keep in (("sses", 2), ("ies", 1), ("ss", 2), ("s", 0)):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix) + keep]
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                if "v" in _shape(base):
                    word = _mended(base)
                break
    if len(word) > 1 and word[-1] == "y" and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (DOUBLE_SUFFIXES, NOUN_SUFFIXES):
        for suffix, to in table:
            if word.endswith(suffix):
                if measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + to
                break
    for suffix in LAST_SUFFIXES:
        base = word[: -len(suffix)]
        if word.endswith(suffix) and measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
            word = base
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _mended(base: str) -> str:
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if measure(base) == 1 and _cvc(base) else base


def tokenize(text: str | None) -> list[str]:
    """Stems of the kept tokens of ``text``, in order."""
    if not text or text.isspace():
        return []
    return [stem(t) for t in _SPLIT.split(text.replace("İ", " ").lower()) if t and t not in _STOP]
