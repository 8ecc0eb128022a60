"""Language profiles: everything an operator needs to know about one language, as data.

``DEFAULT`` holds the standard Latin orthography of the target language; ``FIXTURE`` lets the same
operators run on ordinary western European text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Letters, look-alikes, punctuation, clitics and markers of the orthography.
CONSONANTS = "bcčdḍfgǧɣhḥjklmnpqrṛsṣtṭvwxyzẓ"
VOWELS = "aeiou"
EXTRA_LETTERS = "ɛ"
PUNCTUATION = " \n\t0123456789.,;:!?'\"()[]{}-/%&+=*@#_<>«»"
SPECIAL_LETTERS = "ɛɣḥḍṭṣẓṛčǧƐƔḤḌṬṢẒṚČǦ"
#: Letter -> look-alikes that fold into it.
LOOK_ALIKES = {
    "ɛ": "εϵԑʕƹᵋⱸ",
    "Ɛ": "ΕԐƸ∑",
    "ɣ": "γɤˠᵞℽ",
    "Ɣ": "Γℾ",
    "ḥ": "ħѻ",
    "Ḥ": "Ħ",
    "ṣ": "şș",
    "Ṣ": "ŞȘ",
    "ṭ": "ţț",
    "Ṭ": "ŢȚ",
    "č": "ć",
    "Č": "Ć",
    "ǧ": "ǵğ",
    "Ǧ": "ǴĞ",
}
#: Replacement -> the characters it stands for.
PUNCTUATION_FOLD = {
    "'": "‘’‚‛′`ʼʻ´",
    '"': "“”„‟″",
    "-": "‐‑‒–—―−•",
    " ": "              　 ",
    "": "­​‌‍﻿⁠᠎",
    ".": "·",
    "<": "‹",
    ">": "›",
}
PUNCTUATION_EXPAND = {"…": "..."}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}
CLITICS = (
    "iw inu ik im is nneɣ nnes nwen nkent nsen nsent yi k kem t tt aɣ wen kent ten tent as asen asent ay "
    "yas yasen yasent yaɣ yawen yakent yak yam d id n ed in agi a nni ihin inna agini"
).split()
ADHOC_MARKERS = ("gh", "kh", "dh", "th", "ch", "ou", "aa", "3", "7", "9")
EMPHATIC_FOLD = {"ṛ": "r", "ṣ": "s", "ṭ": "t", "ẓ": "z", "ḍ": "d", "ḥ": "h"}
CHAT_SPELLING = {
    "ɣ": "gh", "Ɣ": "Gh", "ɛ": "3", "Ɛ": "3", "c": "ch", "C": "Ch", "č": "ch", "Č": "Ch", "ǧ": "j", "Ǧ": "J",
    "ḍ": "d", "Ḍ": "D", "ṭ": "t", "Ṭ": "T", "ṣ": "s", "Ṣ": "S", "ẓ": "z", "Ẓ": "Z", "ḥ": "h", "Ḥ": "H",
    "ṛ": "r", "Ṛ": "R", "ə": "e", "«": '"', "»": '"',
}
SPELLING_ERRORS = {"ɣ": "gh", "ɛ": "3", "ḥ": "h", "ḍ": "d", "ṭ": "t", "ṣ": "s", "ẓ": "z", "č": "c", "ǧ": "j", "ṛ": "r"}


@dataclass(frozen=True)
class LanguageProfile:
    """Letters and thresholds of the quality ladder for one language."""

    name: str
    code: str = "kab"
    letters: str = "".join(sorted(set(CONSONANTS + VOWELS + EXTRA_LETTERS)))
    special: str = SPECIAL_LETTERS
    markers: tuple[str, ...] = ADHOC_MARKERS
    clitics: tuple[str, ...] = tuple(CLITICS)
    min_words: int = 5
    max_words: int = 20_000
    min_mean_word: float = 2.5
    max_mean_word: float = 12.0
    min_alpha: float = 0.55
    max_digits: float = 0.20
    max_punctuation: float = 0.25
    char_run: int = 12
    max_repeated_lines: float = 0.30
    min_special: float = 0.015
    max_adhoc: float = 0.25
    max_oov: float = 0.55
    spelling_errors: dict[str, str] = field(default_factory=lambda: dict(SPELLING_ERRORS))

    @property
    def canonical(self) -> str:
        upper = "".join(sorted({c.upper() for c in self.letters}))
        return self.letters + upper + PUNCTUATION


DEFAULT = LanguageProfile("default")
#: Western European letters count as special; no floor on them and rare markers only.
FIXTURE = LanguageProfile(
    "fixture",
    code="en",
    letters="abcdefghijklmnopqrstuvwxyzßàâäçèéêëíîïñóôöùúûüáœ",
    special="äöüßàâçèéêëîïôùûñáíóúÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ",
    markers=("kh", "dh", "aa"),
    min_special=0.0,
    spelling_errors={"é": "e", "è": "e", "ê": "e", "ç": "c", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ñ": "n", "ó": "o", "í": "i", "á": "a"},
)
