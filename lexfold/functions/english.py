"""English words as a full-text index knows them: places, stop words and stems.

Stems follow the published rules of the second Porter stemmer.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that are not indexed. They keep their place, so a phrase knows of the gap. Fixed values.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)

#: Words that the rules would get wrong, and words that they leave alone. Fixed values.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())

#: Suffixes with what takes their place, of the second and third step. Fixed values.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{VOWEL}{OTHER}")
MARKED_Y = re.compile("^y|(?<=[aeiouy])y")
HAS_VOWEL, DOUBLED = re.compile(VOWEL), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
SHORT = re.compile(f"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$")
LONE_S = re.compile(f"{VOWEL}.+s$")
FIRST = ("eedly", "ingly", "edly", "eed", "ing", "ed")
LONGEST_2, LONGEST_3, LONGEST_4 = (tuple(sorted(x, key=len, reverse=True)) for x in (SECOND, THIRD, FOURTH))


def _ending(word: str, options: tuple[str, ...]) -> str | None:
    """The first of the suffixes, longest first, that word ends with."""
    return next(s for s in options if word.endswith(s)) if word.endswith(options) else None


def _after(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    if "y" in word:
        word = MARKED_Y.sub("Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _after(word, 0)
    r2 = _after(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and LONE_S.search(word):
        word = word[:-1]
    if word in KEPT_PLURAL:
        return word

    s = _ending(word, FIRST)
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif s and HAS_VOWEL.search(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif DOUBLED.search(word):
            word = word[:-1]
        elif len(word) <= r1 and SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    s = _ending(word, LONGEST_2)
    if s and len(word) - len(s) >= r1:
        rest = word[: -len(s)]
        if (s != "ogi" or rest.endswith("l")) and (s != "li" or rest[-1:] in tuple("cdeghkmnrt")):
            word = rest + SECOND[s]
    s = _ending(word, LONGEST_3)
    if s and len(word) - len(s) >= (r2 if s == "ative" else r1):
        word = word[: -len(s)] + THIRD[s]
    s = _ending(word, LONGEST_4)
    if s and len(word) - len(s) >= r2 and (s != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(s)]
    last = len(word) - 1
    if word.endswith("e") and (last >= r2 or last >= r1 and not SHORT.search(word[:-1])) or word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.lower()


def words(text: str | None) -> list[str]:
    """All words in order, in lower case; a hyphenated word is followed by its parts."""
    low = (text or "").lower()
    found = TOKEN.findall(low)
    return [p for w in found for p in ((w, *w.split("-")) if "-" in w else (w,))] if "-" in low else found


def term_of(word: str) -> str | None:
    """The term of one of words(), none for a stop word. Words with digits are terms as they are."""
    return None if word in STOP else stem(word) if word.replace("-", "").isalpha() else word


def terms(text: str | None) -> list[tuple[str, int]]:
    """(term, place) of all words but stop words; places count all words from 1."""
    return [(t, at) for at, w in enumerate(words(text), 1) if (t := term_of(w)) is not None]
