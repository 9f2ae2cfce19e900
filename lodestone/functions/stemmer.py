"""The English (Porter2) stemming algorithm, as published, for words of a-z and apostrophes."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
REGION_PREFIXES = ("gener", "commun", "arsen")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _ends_short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _step_1(w: str, r1: int) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if suffix in ("eed", "eedly"):
                w = stem + "ee" if len(stem) >= r1 else w
            elif _has_vowel(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _ends_short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    return w


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    if word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    start = next((len(p) for p in REGION_PREFIXES if w.startswith(p)), None)
    r1 = _region(w, 0) if start is None else start
    r2 = _region(w, r1)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    w = _step_1(w, r1)
    if w in AFTER_1A:
        return w.lower()
    for suffix, new in STEP_2:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            fits = len(stem) >= r1 and (suffix != "ogi" or stem.endswith("l")) and (suffix != "li" or stem[-1:] in LI_BEFORE and stem != "")
            w = stem + new if fits else w
            break
    for suffix, new in STEP_3:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            w = stem + new if len(stem) >= (r2 if suffix == "ative" else r1) else w
            break
    for suffix in STEP_4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            w = stem if len(stem) >= r2 and (suffix != "ion" or stem.endswith(("s", "t"))) else w
            break
    stem = w[:-1]
    if w.endswith("e") and (len(stem) >= r2 or len(stem) >= r1 and not _ends_short(stem)) or w.endswith("ll") and len(stem) >= r2:
        w = stem
    return w.lower()
