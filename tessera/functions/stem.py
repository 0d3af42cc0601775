"""Porter's algorithm (M. F. Porter, 1980) for words of ASCII letters and digits."""

from __future__ import annotations

import re

# Suffix, what takes its place; of each step the first that fits counts.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")

_SEQUENCE = re.compile("v+c")


def _shape(word: str) -> str:
    """word with v for its vowels and c for its other letters; y is a vowel behind
    a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(_SEQUENCE.findall(_shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _first(word: str, suffixes) -> str | None:
    """The longest of the suffixes that word ends in."""
    fit = [s for s in suffixes if word.endswith(s)]
    return max(fit, key=len) if fit else None


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif (end := _first(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP2, STEP3):
        if (end := _first(word, step)) and _measure(word[: -len(end)]):
            word = word[: -len(end)] + step[end]
    if (end := _first(word, STEP4)) and _measure(rest := word[: -len(end)]) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
