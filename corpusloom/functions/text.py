"""String functions as Column builders, all but the names of characters in the JVM.

Character classes are spelled out so that results follow Unicode categories, not a regex engine's
shorthand: a letter or numeral of a word is [\\p{L}\\p{Nl}\\p{No}].
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .profile import CHAT_SPELLING, DEFAULT, EMPHATIC_FOLD, LIGATURES, LOOK_ALIKES, PUNCTUATION_EXPAND, PUNCTUATION_FOLD, LanguageProfile

WORD_CLASS = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{WORD_CLASS}+(?:[-']{WORD_CLASS}+)*"
IDENT = r"[\p{L}\p{N}_]"
STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _icu(method: str, c: Column, compat: bool, given: Column) -> Column:
    """``c`` under a normal form of ICU, in the JVM: no text crosses to Python. Null where ``given`` is,
    the column that ``c`` is made of; ``c`` itself stands here once, or its steps would run twice."""
    call = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(compat))
    return F.when(given.isNotNull(), call)


def nfc(c: Column, given: Column | None = None) -> Column:
    """Canonical composition."""
    return _icu("compose", c, False, c if given is None else given)


def _ranges(test: Callable[[str], bool]) -> str:
    """The characters that pass ``test``, as the inside of a character class."""
    codes = [i for i in range(sys.maxunicode + 1) if test(chr(i))]
    first = [i for k, i in enumerate(codes) if not k or codes[k - 1] != i - 1]
    last = [i for k, i in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != i + 1]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last, strict=True))


#: Characters of a combining class. All are marks, or newer than the JVM's tables; that test is the cheaper and comes first.
COMBINING = rf"[\p{{M}}\p{{Cn}}&&[{_ranges(lambda c: unicodedata.combining(c) != 0)}]]+"


def _bare(c: Column) -> Column:
    return F.regexp_replace(_icu("decompose", F.lower(c), True, c), COMBINING, "")


@F.pandas_udf(StringType())
def _character_name(char: pd.Series) -> pd.Series:
    return char.map(lambda c: f"U+{ord(c):04X} {unicodedata.name(c, '<unnamed>')}" if c else None, na_action="ignore")


def character_name(char: Column) -> Column:
    """``U+XXXX NAME`` of one character."""
    return _character_name(char)


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, STRIP, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}]")


def words(c: Column) -> Column:
    """Words with inner hyphens and apostrophes kept."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def map_characters(c: Column, table: dict[str, str]) -> Column:
    """Each character replaced once. Targets of several characters must not hold later keys."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    if single or gone:
        c = F.translate(c, "".join([*single, *gone]), "".join(single.values()))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in table.items() if len(v) > 1), c)


def fold_table() -> dict[str, str]:
    """Look-alike -> letter, and punctuation variant -> plain form."""
    return {s: t for t, sources in (LOOK_ALIKES | PUNCTUATION_FOLD).items() for s in sources}


def normalize(c: Column, profile: LanguageProfile = DEFAULT, *, dehyphenate: bool = True, unicode_forms: bool = True) -> Column:
    """Fold text onto the profile's character set: ligatures, look-alikes, punctuation, control
    characters, words broken over lines, detached clitics, white space.

    A null stays null. ``unicode_forms=False`` skips NFC for text known to be composed.
    """
    given = c
    c = nfc(c) if unicode_forms else c
    c = map_characters(c, LIGATURES)
    c = map_characters(c, fold_table())
    c = map_characters(c, PUNCTUATION_EXPAND)
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    clitics = "|".join(sorted(profile.clitics, key=lambda x: (-len(x), x)))
    if dehyphenate:
        # One scan: the hyphen is captured, so kept, only before a clitic.
        gap = r"[ \t]*\n[ \t]*"
        c = F.regexp_replace(c, rf"({IDENT})(?:(-){gap}(?=(?iu:{clitics})(?!{IDENT}))|-{gap})([a-zɛɣḥḍṭṣẓṛčǧ]{IDENT}*)", "$1$2$3")
    c = F.regexp_replace(c, rf"({IDENT})[\s\p{{Z}}]*-[\s\p{{Z}}]+({clitics})(?!{IDENT})", "$1-$2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(nfc(c, given) if unicode_forms else c)


def canonical_key(c: Column) -> Column:
    """Case, accents and punctuation folded away; equal keys are exact duplicates."""
    return F.trim(F.regexp_replace(_bare(c), r"[^\p{L}\p{N}]+", " "))


def exact_hash(c: Column) -> Column:
    return F.md5(canonical_key(c))


def weighted(weight: str | None) -> Column:
    """Rows of a group, each as often as its column ``weight`` says."""
    return F.sum(weight) if weight else F.count("*")


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def class_of(letters: str) -> str:
    return "[" + "".join("\\" + x if x in "\\]^-[" else x for x in letters) + "]"


def quick_class(letters: str, *, negate: bool = False) -> str:
    """``class_of``, or its complement, for the JVM: one test tells ASCII from the rest, so that plain text is not held
    against each foreign letter in turn."""
    ascii_part = "".join(rf"\x{i:02X}" for i in range(128) if (chr(i) in letters) != negate)
    rest = "".join(rf"\x{{{ord(x):X}}}" for x in sorted(set(letters)) if not x.isascii())
    if not rest:
        return f"[{ascii_part}" + ("[^\\x00-\\x7F]]" if negate else "]")
    return f"[{ascii_part}[[^\\x00-\\x7F]&&[{'^' if negate else ''}{rest}]]]"


def special_rate(c: Column, profile: LanguageProfile = DEFAULT) -> Column:
    """Share of letters that are special to the language; 0 without letters."""
    special = F.regexp_count(c, F.lit(quick_class(profile.special)))
    return F.coalesce(F.try_divide(special.cast("double"), letter_count(c)), F.lit(0.0))


def adhoc_score(c: Column, profile: LanguageProfile = DEFAULT) -> Column:
    """Share of lower-cased words that hold a marker of improvised spelling; 0 without words."""
    w = words(F.lower(c))
    # One match a word, from its first marker to its end; no lambda, so the words are made once.
    hits = F.regexp_count(F.array_join(w, "\n"), F.lit(f"(?:{'|'.join(profile.markers)})[^\n]*"))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(w)), F.lit(0.0))


def strip_residual(c: Column, profile: LanguageProfile = DEFAULT, keep: str = "") -> Column:
    """Without the characters outside the profile's set (and ``keep``)."""
    return F.regexp_replace(c, quick_class(profile.canonical + keep, negate=True) + "+", "")


def fold_emphatics(c: Column) -> Column:
    return map_characters(c, EMPHATIC_FOLD)


def sentences(c: Column) -> Column:
    """Split after . ! or ? followed by white space; blank parts dropped."""
    parts = F.transform(F.split(c, r"(?<=[.!?])[\s\p{Z}]+"), strip)
    return F.filter(parts, lambda s: s != "")


def to_chat_spelling(c: Column) -> Column:
    """Standard orthography as it is typed on a phone: tags and private-use symbols out, letters
    mapped (``c`` before the caron letters, whose targets hold a ``c``), letter-letter hyphens joined."""
    c = F.regexp_replace(c, r"</?[a-zA-Z][^<>]{0,40}>|[-]", "")
    plain = {k: v for k, v in CHAT_SPELLING.items() if k in "cC"}
    c = map_characters(map_characters(c, plain), {k: v for k, v in CHAT_SPELLING.items() if k not in plain})
    c = F.regexp_replace(c, rf"(?<={WORD_CLASS})-(?={WORD_CLASS})", "")
    return strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


# What counts as noise in a chat message.
CHAT_NOTICE = r"(?iu)^(?:vous avez supprimé ce message|ce message a été supprimé)\.?$"
CHAT_NOISE = {
    "tags": r"(?iu)<[^<>]*(?:modifié|omis|supprimé)[^<>]*>",
    "links": r"(?iu)(?:https?://|(?<![\p{L}\p{N}_])www\.)[^\s\p{Z}]+",
    "emails": r"(?i)[^\s\p{Z}]+@[^\s\p{Z}]+\.[a-z]{2,}",
    "phones": r"(?:\+|(?<![\p{L}\p{N}_])00)\d{3}[\s.-]?\d(?:[\s.-]?\d{2}){4}(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])0[5-7]\d{2}(?:[\s.-]?\d{2}){3}(?![\p{L}\p{N}_])",
}
CHAT_REPEAT = 4


def clean_chat(c: Column) -> Column:
    """Struct of the cleaned message (null if nothing is left) and what was counted on the way."""
    line = strip(F.coalesce(c, F.lit("")))
    empty = line == ""
    notice = ~empty & line.rlike(CHAT_NOTICE)
    live = ~empty & ~notice
    counts = {}
    for name, pattern in CHAT_NOISE.items():
        counts[name] = F.when(live, F.regexp_count(line, F.lit(pattern))).otherwise(0).alias(name)
        line = F.regexp_replace(line, pattern, "")
    pattern = rf"(.{{1,2}}?)\1{{{CHAT_REPEAT},}}"
    counts["repeats"] = F.when(live, F.regexp_count(line, F.lit(pattern))).otherwise(0).alias("repeats")
    line = strip(F.regexp_replace(F.regexp_replace(line, pattern, "$1" * CHAT_REPEAT), r"[\s\p{Z}]+", " "))
    emptied = live & (line == "")
    return F.struct(F.when(live & ~emptied, line).alias("message"), empty.cast("int").alias("empty"), notice.cast("int").alias("notices"), *counts.values(), emptied.cast("int").alias("emptied"))


def hash_int(*parts: Column) -> Column:
    """32-bit integer from md5 of the parts joined by '|'; equal in any SQL engine."""
    joined = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def bpe_pretokens(c: Column) -> Column:
    """Pre-tokens of the byte-level BPE: words with a leading space, symbol runs, white space."""
    return F.regexp_extract_all(c, F.lit(r" ?[\p{L}\p{N}][\p{L}\p{N}\p{M}]*| ?[^\s\p{L}\p{N}]+|\s+"), F.lit(0))


def simple_tokens(c: Column) -> Column:
    """Lower-cased words and single symbols."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{IDENT}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]"), F.lit(0))


def detokenize(tokens: Column) -> Column:
    """Join tokens with single spaces, none before closing marks nor after opening ones."""
    text = F.array_join(tokens, " ")
    text = F.regexp_replace(text, r" ([.,;:!?%)\]}»])", "$1")
    return F.regexp_replace(text, r"([(\[{«]) ", "$1")


def language_label(c: Column, profile: LanguageProfile = DEFAULT) -> Column:
    """Label of the model-free identifier: the profile's code where special letters pass 2 percent."""
    return F.when(special_rate(c, profile) > 0.02, F.lit(f"{profile.code}_Latn")).otherwise(F.lit("unk"))


def chatml(messages: Column) -> Column:
    """Messages (role, content) in ChatML."""
    return F.aggregate(messages, F.lit(""), lambda acc, m: F.concat(acc, F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
