"""English word normalisation: stop words and the public suffix-stripping rules (Porter, 1980; second English version).

`normalise` is called once per distinct word of an Arrow batch, never per token; see `fulltext.text_vector`.
"""

from __future__ import annotations

# English stop words of the full-text configuration.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now
""".split()

# Words with a prescribed stem, words left alone after plural removal, and prefixes with a fixed first region.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_WORDS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
FIXED_PREFIXES = ["gener", "commun", "arsen"]

# Suffix replacements of the derivational steps.
DERIVATION = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
SECOND_DERIVATION = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
ENDINGS = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
           "ive", "ize", "ion"]
LI_BEFORE = "cdeghkmnrt"
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
VOWELS = "aeiouy"

_STOP = frozenset(STOP_WORDS)


def _vowel(word: str, i: int) -> bool:
    return word[i] in VOWELS


def _region(word: str, start: int) -> int:
    """Index just past the first consonant that follows a vowel, searching from `start`."""
    for i in range(start + 1, len(word)):
        if not _vowel(word, i) and _vowel(word, i - 1):
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    n = len(word)
    if n == 2:
        return _vowel(word, 0) and not _vowel(word, 1)
    return (
        n > 2
        and not _vowel(word, n - 3)
        and _vowel(word, n - 2)
        and not _vowel(word, n - 1)
        and word[-1] not in "wxY"
    )


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]

    # a consonantal y is written Y while the rules run
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)

    prefix = _longest_prefix(word)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)

    word = _plural(word)
    if word in KEPT_WORDS:
        return word
    word = _past_and_gerund(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _vowel(word, len(word) - 2):
        word = word[:-1] + "i"
    word = _derive(word, DERIVATION, r1, r2)
    word = _derive(word, SECOND_DERIVATION, r1, r2)

    suffix = _longest(word, ENDINGS)
    if suffix and len(word) - len(suffix) >= r2:
        if suffix != "ion" or word[: -len(suffix)].endswith(("s", "t")):
            word = word[: -len(suffix)]

    at = len(word) - 1
    if word.endswith("e"):
        if at >= r2 or (at >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.lower()


def _longest_prefix(word: str) -> str | None:
    return next((p for p in FIXED_PREFIXES if word.startswith(p)), None)


def _plural(word: str) -> str:
    suffix = _longest(word, ["sses", "ied", "ies", "us", "ss", "s"])
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if suffix == "s" and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past_and_gerund(word: str, r1: int) -> str:
    suffix = _longest(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(tuple(DOUBLES)):
        return base[:-1]
    if r1 >= len(base) and _ends_short(base):
        return base + "e"
    return base


def _derive(word: str, table: dict[str, str], r1: int, r2: int) -> str:
    suffix = _longest(word, table)
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if len(base) < r1:
        return word
    if suffix == "ogi" and not base.endswith("l"):
        return word
    if suffix == "li" and not (base and base[-1] in LI_BEFORE):
        return word
    if suffix == "ative" and len(base) < r2:
        return word
    return base + table[suffix]


def normalise_english(word: str) -> str | None:
    """Stem of a lower-case word; None for a stop word."""
    return None if word in _STOP else stem(word)
