"""Tokens of full-text search: letter and digit runs, folded, without marks, stemmed by Porter's algorithm of 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")
#: ASCII characters that no word holds, as spaces.
GAPS = {k: " " for k in range(128) if not chr(k).isalnum()}

# The suffix rules of the published algorithm, steps 2 to 4, longest first where they share an end.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", shape(stem)))


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def replaced(word: str, rules: list[tuple[str, str]]) -> str:
    """The longest suffix that fits decides, whether or not what stands before is long enough."""
    fits = [r for r in rules if word.endswith(r[0])]
    if fits:
        suffix, new = max(fits, key=lambda r: len(r[0]))
        stem = word[: -len(suffix)]
        if measure(stem) > 0:
            return stem + new
    return word


@lru_cache(1 << 16)
def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    again = False
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in shape(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and "v" in shape(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP2), STEP3)
    fits = [s for s in STEP4 if word.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        cut = word[: -len(suffix)] + suffix[0] if suffix in ("sion", "tion") else word[: -len(suffix)]
        if measure(cut) > 1:
            word = cut
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short_end(stem)):
            word = stem
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(unicodedata.normalize("NFC", text))]


@lru_cache(1 << 17)
def term(word: str, stem: bool = True) -> str:
    """What a word is found by; words repeat, so most are looked up."""
    return porter(folded(word)) if stem else folded(word)


def raw(text: str | None) -> list[str]:
    """The words as they stand in the composed text."""
    if not text:
        return []
    return text.translate(GAPS).split() if text.isascii() else WORD.findall(unicodedata.normalize("NFC", text))


def tokens(text: str | None, stem: bool = True) -> list[str]:
    return [term(w, stem) for w in raw(text)]
