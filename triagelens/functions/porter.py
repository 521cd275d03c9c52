"""The Porter (1980) suffix stripper with the common later extensions.

Rules are data: each step is a table of (suffix, replacement, condition) and the first
suffix that fits decides.  Used on single tokens inside Arrow batches only.
"""

from __future__ import annotations

import re

# Words that do not follow the rules.
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning",
    "outings": "outing", "cannings": "canning", "sky": "sky", "news": "news",
    "inning": "inning", "outing": "outing", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix tables of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One ``v`` or ``c`` per letter; ``y`` is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            base = word[: -len(suffix)]
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_consonant(base):
                return base if base[-1] in "lsz" else base[:-1]
            if _measure(base) == 1 and _short_end(base):
                return base + "e"
            return base
    return word


def _final_y(word: str) -> str:
    base = word[:-1]
    if word.endswith("y") and len(base) > 1 and _shape(base)[-1] == "c":
        return base + "i"
    return word


def _table(word: str, rules) -> str:
    for suffix, replacement in rules:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + replacement if _measure(base) > 0 else word
    return word


def _step2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step2(word[:-4] + "al")
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _table(word, STEP2)


def _step4(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                return base
            return word
    return word


def _final_e(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        n = _measure(base)
        if n > 1 or (n == 1 and not _short_end(base)):
            return base
    return word


def _double_l(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _step2, lambda w: _table(w, STEP3), _step4,
                 _final_e, _double_l):
        word = step(word)
    return word
