"""Character tables for folding and transliteration, made from rules.

The blocks of Indic scripts in Unicode follow one layout: a sound has the same distance from
the start of each block. So one table of sounds, and what a script adds or leaves out, gives
every script's letters.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# Latin spelling of each sound by its distance from the start of a block.
SOUNDS = {
    0x02: "n", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "ya", 0x30: "r", 0x32: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u",
    0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au", 0x4D: "",
}
# Start of each script's block, and where it differs from SOUNDS (None: left as it is).
_SOUTH = {0x0E: "e", 0x12: "o", 0x31: "r", 0x33: "l", 0x46: "e", 0x4A: "o"}
SCRIPTS = {
    "devanagari": (0x0900, {0x01: "n", 0x03: "h", 0x0B: "ri", 0x0E: "e", 0x12: "o", 0x33: "l", 0x43: "ri", 0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f"}),
    "bengali": (0x0980, {0x2C: "v"}),
    "gujarati": (0x0A80, {}),
    "tamil": (0x0B80, _SOUTH | {0x02: None, 0x24: "th", 0x29: "n", 0x34: "zh"}),
    "telugu": (0x0C00, _SOUTH),
    "kannada": (0x0C80, _SOUTH),
}
# Fixed value: one more character that is spelled out.
STRAY = {"ࠂ": "m"}

# Ligatures and quotation marks.
LIGATURES = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "«": " ", "»": " ", "“": " ", "”": " ", "’": "'", "`": "'"}


@cache
def indic_letters() -> dict[str, str]:
    """Latin spelling of each letter of the scripts above that Unicode assigns."""
    out = dict(STRAY)
    for start, own in SCRIPTS.values():
        for at, sound in (SOUNDS | own).items():
            letter = chr(start + at)
            if sound is not None and unicodedata.category(letter) != "Cn":
                out[letter] = sound
    return out


def folded(letter: str) -> str:
    """A character decomposed for compatibility, without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).lower()


@cache
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that fold to at most one character, and those that fold to more.

    Spelled-out Indic letters come before decomposition. Hangul syllables stay whole: their
    parts are no Latin letters either.
    """
    letters = indic_letters()
    single, several = {}, {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x1F200), *range(0x1FBF0, 0x1FBFA), *range(0x2F800, 0x2FA1E)]:
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Co"):
            continue
        to = letters[c] if c in letters else folded(c)
        if to != c.lower():
            (single if len(to) <= 1 else several)[c] = to
    return single, several
