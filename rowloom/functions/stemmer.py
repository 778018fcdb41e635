"""The suffix-stripping stemmer of Porter's paper of 1980, in its five steps.

A word is a run of consonants and vowels, [C](VC)^m[V]; m is its measure. A rule replaces an ending if what is left of it has
enough measure. Each step takes the longest ending that its list has, and does nothing if its condition fails."""

from __future__ import annotations

import re

# --- fixed values: endings as the paper lists them, by step

STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# --- the measure and the steps


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c", shape(word)))


def short_syllable(word: str) -> bool:
    """Ends in consonant, vowel, consonant, of which the last isn't w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    found = longest(word, [e for e, _ in rules])
    if found is None or measure(word[: len(word) - len(found)]) < least:
        return word
    return word[: len(word) - len(found)] + dict(rules)[found]


def plural(w: str) -> str:
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            return w[: len(w) - len(ending)] + new
    return w


def past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    ending = longest(w, ("ed", "ing"))
    if ending is None or "v" not in shape(w[: len(w) - len(ending)]):
        return w
    w = w[: len(w) - len(ending)]
    if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and short_syllable(w)):
        return w + "e"
    return w[:-1] if doubled(w) and w[-1] not in "lsz" else w


def bare(w: str) -> str:
    ending = longest(w, STEP_4)
    if ending is None:
        return w
    rest = w[: len(w) - len(ending)]
    return rest if measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))) else w


def tidied(w: str) -> str:
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_syllable(w[:-1]))):
        w = w[:-1]
    return w[:-1] if doubled(w) and w[-1] == "l" and measure(w) > 1 else w


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = past(plural(w))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    return tidied(bare(replaced(replaced(w, STEP_2, 1), STEP_3, 1)))
