"""English stems by Porter's published algorithm, and letters without their accents."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# The suffixes of the published steps and what takes their place, longest first where one ends another.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al",
    "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "ator": "ate", "logi": "log", "bli": "ble", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _vowels(word: str) -> list[bool]:
    """Of each letter, whether it is a vowel; a y is one after a consonant."""
    out: list[bool] = []
    for c in word:
        out.append(c in "aeiou" or c == "y" and bool(out) and not out[-1])
    return out


def _measure(stem: str) -> int:
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _ends_double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and not _vowels(stem)[-1]


def _ends_cvc(stem: str) -> bool:
    return len(stem) > 2 and _vowels(stem)[-3:] == [False, True, False] and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix, other in rules.items():
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if _measure(stem) > 0 else word
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
    stem = word[: len(word) - cut]
    if not cut or not any(_vowels(stem)):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _ends_double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for suffix in STEP_4:
        if word.endswith(suffix):
            short = word[: -len(suffix)]
            if _measure(short) > 1 and (suffix != "ion" or short.endswith(("s", "t"))):
                word = short
            break
    if word.endswith("e"):
        short = word[:-1]
        if _measure(short) > 1 or _measure(short) == 1 and not _ends_cvc(short):
            word = short
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Small letters that are another letter with accents, and those: from Unicode's decompositions."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isalpha() and chr(code).islower() and all(unicodedata.combining(m) for m in marks):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())
