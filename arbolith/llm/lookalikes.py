"""Characters that look the same: fixed tables and rules on single texts and words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other alphabets that look like the Latin letter before them.
CYRILLIC = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х",
    "Y": "У", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ",
    "x": "х", "y": "у",
}
GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
    "i": "ι", "o": "ο", "v": "ν",
}
#: Further letters of these alphabets that look like a Latin one, with that one.
ALSO_LATIN = {"Ү": "Y", "ѵ": "v", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J"}
#: Other signs that look like a Latin letter, whatever stands around them.
SAME = {"ɡ": "g", "ɑ": "a", "օ": "o", "ⅼ": "l"}
#: Characters that can't be seen, and blanks of one kind or another.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
BLANK = "   -   　"

#: Compatibility forms that differ in width, joining or coding only (not raised or circled ones).
_PLAIN = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_INVISIBLE, _BLANK = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{BLANK}]")


class _Forms(dict):
    """What each character becomes; worked out when first met."""

    def __missing__(self, code: int):
        char = chr(code)
        if _INVISIBLE.match(char):
            made = ""
        elif _BLANK.match(char):
            made = " "
        elif char in SAME:
            made = SAME[char]
        elif unicodedata.decomposition(char).startswith(_PLAIN):
            made = unicodedata.normalize("NFKC", char)
        else:
            made = char
        self[code] = made
        return made


_FORMS = _Forms()
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_TO_LATIN = {v: k for table in (CYRILLIC, GREEK) for k, v in table.items()} | ALSO_LATIN
_TO_LATIN_TABLE = str.maketrans(_TO_LATIN)
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_LETTER = r"(?:[^\W\d_]|[̀-ͯ])"
#: A word, accents that have no composed letter included, with a letter of another alphabet in it.
WORD_WITH_FOREIGN = re.compile(rf"(?<![^\W\d_])(?<![̀-ͯ])(?:[^\W\d_Ͱ-ԯ]|[̀-ͯ])*+[Ͱ-ԯ]{_LETTER}*")


def uniform(text: str) -> str:
    """One width, no joined letters, no unseen characters, one kind of blank, composed accents."""
    if text.isascii():
        return text
    for char in set(_BEYOND_ASCII.findall(text)):
        form = _FORMS[ord(char)]
        if form != char:
            text = text.replace(char, form)
    return unicodedata.normalize("NFC", text)


def has_foreign(text: str) -> bool:
    return not text.isascii() and _FOREIGN.search(text) is not None


@lru_cache(maxsize=2_000)
def _latin_twin(char: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", char).translate(_TO_LATIN_TABLE))


def latinized(text: str) -> str:
    """Every look-alike letter as its Latin twin, whatever the word: for comparison with Latin text."""
    if text.isascii():
        return text
    text = uniform(text)
    for char in set(_FOREIGN.findall(text)):
        text = text.replace(char, _latin_twin(char))
    return text


def _script(char: str) -> str:
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    return "other"


def _as(char: str, script: str) -> str | None:
    """The letter of that script that looks like ``char``, or None."""
    if not char.isalpha() or _script(char) == script:
        return char
    latin = char if _script(char) == "latin" else _TO_LATIN.get(char)
    if latin is None or script == "latin":
        return latin
    return (CYRILLIC if script == "cyrillic" else GREEK).get(latin)


@lru_cache(maxsize=200_000)
def readings(word: str) -> tuple[bool, tuple[str, ...]]:
    """(mixed, ways): whether letters of several scripts meet in the word, and how it reads in one script.

    The dominant script comes first: the one with letters that have no twin elsewhere, then the
    one with more letters, Latin on a tie. A script is left out if a letter has no twin in it.
    """
    parts = unicodedata.normalize("NFD", word)
    scripts = [_script(c) for c in parts if c.isalpha()]
    present = [s for s in ("latin", "cyrillic", "greek") if s in scripts]
    if "other" in scripts or not present:
        return False, ()
    ways = []
    for script in present:
        twins = [_as(c, script) for c in parts]
        if None not in twins:
            anchored = sum(1 for c in parts if c.isalpha() and _script(c) == script and all(_as(c, o) is None for o in present if o != script))
            ways.append((-anchored, -scripts.count(script), len(ways), unicodedata.normalize("NFC", "".join(twins))))
    return len(present) > 1, tuple(w[3] for w in sorted(ways))


@lru_cache(maxsize=200_000)
def latin_twin(word: str) -> str:
    """A word in one other alphabet whose letters all look like Latin ones, as these; any other word as it is."""
    parts = unicodedata.normalize("NFD", word)
    if any(_script(c) == "latin" for c in parts if c.isalpha()):
        return word
    latin = [_as(c, "latin") for c in parts]
    return word if None in latin else unicodedata.normalize("NFC", "".join(latin))


def foreign_words(text: str) -> set[str]:
    """The distinct words of a text that hold letters of other alphabets."""
    return set(WORD_WITH_FOREIGN.findall(text)) if has_foreign(text) else set()


def keyed(text: str, foreign: set[str] | None = None) -> str:
    """The text with each word wholly of look-alikes (``foreign``: the words with foreign letters, if known) in Latin letters.

    For comparison only: such a word is in one alphabet, so there is nothing in it to repair, but
    its letters can't be told from Latin ones. Words of several alphabets stay as they are.
    """
    changed = {w: k for w in (foreign_words(text) if foreign is None else foreign) if (k := latin_twin(w)) != w}
    return WORD_WITH_FOREIGN.sub(lambda m: changed.get(m[0], m[0]), text) if changed else text
