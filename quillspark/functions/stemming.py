"""English stemming by the published Porter2 rules; other languages by light suffix stripping."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FIXED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_V = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    found = re.match(r"gener|commun|arsen", word)
    if found:
        r1 = found.end()
    else:
        found = re.search(f"[{_V}][^{_V}]", word)
        r1 = found.end() if found else len(word)
    found = re.search(f"[{_V}][^{_V}]", word[r1:])
    return r1, r1 + found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(f"[{_V}][^{_V}]", word))


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _FIXED:
        return word
    word = re.sub(f"(^y|(?<=[{_V}])y)", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    found = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", word)
    if found:
        stem = word[: found.start()]
        if found[0] in ("eed", "eedly"):
            if found.start() >= r1:
                word = stem + "ee"
        elif re.search(f"[{_V}]", stem):
            word = stem
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif _short_end(word) and r1 >= len(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # 2
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in "cdeghkmnrt":
            word = word[:-2]
    # 3
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: -len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_LIGHT = {
    "de": ["ungen", "heit", "keit", "isch", "ung", "ern", "em", "en", "er", "es", "e", "s"],
    "fr": ["issements", "issement", "ements", "ement", "ations", "ation", "euses", "euse", "ives", "ive", "ees", "es", "ee", "s", "e"],
    "es": ["aciones", "acion", "amiento", "mente", "idades", "idad", "ando", "iendo", "adas", "ados", "ada", "ado", "as", "os", "es", "a", "o", "e"],
    "it": ["azioni", "azione", "mente", "ando", "endo", "ati", "ate", "i", "e", "a", "o"],
    "pt": ["acoes", "acao", "mente", "ando", "endo", "as", "os", "es", "a", "o", "e"],
    "nl": ["heden", "heid", "en", "e", "s"],
    "sv": ["heten", "arna", "erna", "orna", "ar", "er", "or", "en", "et", "a", "e"],
    "da": ["erne", "ene", "er", "en", "et", "e", "s"],
    "no": ["ene", "ane", "er", "en", "et", "e", "a", "s"],
}


def stemmer(code: str) -> Callable[[str], str]:
    """The stemmer of a language; words of languages without one stay as they are."""
    if code == "en":
        return english
    ends = _LIGHT.get(code, [])

    def strip(word: str) -> str:
        for end in ends:
            if word.endswith(end) and len(word) - len(end) >= 3:
                return word[: -len(end)]
        return word

    return strip
