"""Orthography: normalisation, maps, tokens and quality signals on single strings."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import DEFAULT
from corpusloom.operators import fonts, quality


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.out for r in df.select("i", f(F.col("t")).alias("out")).orderBy("i").collect()]


NORMAL = [
    ("ε", "ɛ"), ("ԑ", "ɛ"), ("Ԑ", "Ɛ"), ("ɤ", "ɣ"), ("γ", "ɣ"), ("Γ", "Ɣ"), ("ħ", "ḥ"), ("ș", "ṣ"), ("ț", "ṭ"),
    ("ḥ", "ḥ"), ("ḍ", "ḍ"), ("Ԑmiruc", "Ɛmiruc"), ("iԑ-d-ismenԑen", "iɛ-d-ismenɛen"),
    ("aﬁx", "afix"), ("ﬂuks", "fluks"), ("tamu-\nrt", "tamurt"), ("imezda-\nɣen", "imezdaɣen"),
    ("yewweḍ-\nd", "yewweḍ-d"), ("bab-\nis", "bab-is"), ("axxam-\nnneɣ", "axxam-nneɣ"), ("yenna- yas", "yenna-yas"), ("zedɣen- tt", "zedɣen-tt"),
    ("13 yennayer - 14 yennayer", "13 yennayer - 14 yennayer"), ("a-\nb-\nc", "ab-\nc"), ("  x \t y  \n\n\n\n z ", "x y\n\nz"), ("“x”… y​", '"x"... y'), (None, None), ("", ""),
]


def test_normalize(spark):
    assert apply(spark, T.normalize, [raw for raw, _ in NORMAL]) == [want for _, want in NORMAL]


def test_normalized_text_is_canonical(spark):
    mixed = "Ԑmmi γer – ‘x’ “y”… ş"
    assert apply(spark, lambda c: F.regexp_replace(T.normalize(c), T.class_of(DEFAULT.canonical), ""), [mixed]) == [""]


@pytest.mark.parametrize(
    ("table", "raw", "want"),
    [(fonts.MAP_A, *x.split(":")) for x in "aîas:aṭas neéra:neẓra yelêan:yelḥan uôumi:uṛumi laûel:laṣel maççi:mačči yettwan$a:yettwanɣa yewwev-ed:yewweḍ-ed".split()]
    + [(fonts.MAP_B, *x.split(":")) for x in "ùef:ɣef ayùer:ayɣer lqaµa:lqaɛa ime§§i:imeṭṭi ñagwad:ṭṭagwad".split()],
)
def test_font_maps(spark, table, raw, want):
    assert apply(spark, lambda c: fonts.apply_map(c, table), [raw]) == [want]


def test_font_maps_are_injective_per_face():
    for table in (fonts.MAP_A, fonts.MAP_B):
        single = [v for v in table.values() if len(v) == 1]
        assert len(single) == len(set(single))
    assert fonts.MAP_A["ê"] == "ḥ" and fonts.MAP_B["ê"] == "ṛ"


def test_font_lookup(spark):
    names = ["ABCDEF+AmazighBangle", "XYZ+Tayma-Tlika", "TimesNewRoman", None]
    assert apply(spark, fonts.Registry().map_name, names) == ["map_a", "map_b", None, None]
    more = fonts.Registry().register("TimesNew", {"x": "ɣ"})
    assert apply(spark, more.map_name, names)[2] == "found:timesnew"


def test_words_and_rates(spark):
    assert apply(spark, T.words, ["zedɣen-tt deg wexxam", "3emmi l'axxam_x", ""]) == [["zedɣen-tt", "deg", "wexxam"], ["emmi", "l'axxam", "x"], []]
    assert apply(spark, T.adhoc_score, ["3emmi ghef thaddarth ikhdem", "azul fell-awen", ""])[0] > 0.5
    assert apply(spark, T.adhoc_score, ["azul fell-awen", ""]) == [0.0, 0.0]
    high, low, none = apply(spark, T.special_rate, ["Yenna-yas ɣef taddart d wemḍan n yiḥricen", "Le chat est sur la table", "123"])
    assert high > 0.05 and low < 0.01 and none == 0.0


def test_emphatics_fold_but_distinct_letters_stay(spark):
    assert apply(spark, T.fold_emphatics, ["uṛumi", "aṭas", "ɣɛčǧ"]) == ["urumi", "atas", "ɣɛčǧ"]


def test_chat_spelling(spark):
    raw = ["yenna-yas ɣef čči c", "<b>ǧǧiɣ</b>  Ɛli", "1-2 a-b-c-d"]
    assert apply(spark, T.to_chat_spelling, raw) == ["yennayas ghef chchi ch", "jjigh 3li", "1-2 abchd"]


def test_chat_cleaning(spark):
    raw = ["Vous avez supprimé ce message.", "  ", "azul <Ce message a été modifié> hhhhhhhhh", "https://x.y/z", "a@b.com ok", "appelle 0551 23 45 67 stp", None]
    out = apply(spark, T.clean_chat, raw)
    assert [r.message for r in out] == [None, None, "azul hhhh", None, "ok", "appelle stp", None]
    assert [(r.notices, r.empty, r.emptied) for r in out][:4] == [(1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]
    assert out[2].tags == 1 and out[2].repeats == 1 and out[3].links == 1 and out[4].emails == 1 and out[5].phones == 1


def test_sentences_tokens_and_chatml(spark):
    assert apply(spark, T.sentences, ["One. Two!  Three?\nfour", " ", ""]) == [["One.", "Two!", "Three?", "four"], [], []]
    assert apply(spark, T.simple_tokens, ["Azul, fell-ak!"]) == [["azul", ",", "fell", "-", "ak", "!"]]
    assert apply(spark, T.detokenize, [["azul", ",", "(", "x", ")", "."]], "array<string>") == ["azul, (x)."]


LADDER = [
    (None, "empty"), (" \n", "empty"), ("a b c", "too_short"), ("a " * 20_001, "too_long"), ("a b c d e f", "words_too_short"), ("abcdefghijklmn " * 6, "words_too_long"),
    ("abc def ghi jkl mno ....................................................", "low_alpha"), ("abcde fghij klmno pqrst uvwxy 1234567890 12", "digit_heavy"),
    ("abcde! fghij! klmno! pqrst!? uvwxy!!!! z!!", "punct_heavy"), ("hello there you aaaaaaaaaaaa good people", "char_run"), ("same line here now\n" * 5, "repeated_lines"), ("the cat is on the table today", "not_kabyle_charset"),
    ("ghef thaddarth ikhdem chouia ɣɣɣ ɛɛɛ", "adhoc_orthography"), ("yenna-yas ɣef taddart n yimezdaɣ iḥricen", None),
]


def test_quality_ladder(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LADDER)], "doc_id int, text string")
    got = [r.reject_reason for r in quality.with_reason(df).orderBy("doc_id").collect()]
    assert got == [want for _, want in LADDER]


def test_char_run_threshold(spark):
    df = spark.createDataFrame([(0, "hello kids yes " + "ɣ" * 11 + " big dog"), (1, "hello kids yes " + "ɣ" * 12 + " big dog")], "doc_id int, text string")
    assert [r.reject_reason for r in quality.with_reason(df).orderBy("doc_id").collect()] == [None, "char_run"]


def test_running_heads(spark):
    text = "\n".join(["HEAD", "a", " 12 ", "HEAD", "b", "HEAD", "four", "HEAD", "four", "HEAD", "four", "four"])
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert quality.strip_running_heads(df).first().text == "a\nb\nfour\nfour\nfour\nfour"


def test_character_name(spark):
    assert apply(spark, T.character_name, ["ɛ"]) == ["U+025B LATIN SMALL LETTER OPEN E"]


def test_normal_forms_stay_in_the_jvm(spark):
    texts = ["éạ́", "ẛ̣", "ﬁn ① İI ΣΑΣ", "각", "aͅ\U0001e94ab", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", T.nfc(F.col("t")).alias("n"), T.canonical_key(F.col("t")).alias("k"), T.normalize(F.col("t")).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.t is None:
            assert (r.n, r.k, r.m) == (None, None, None)
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", r.t.lower()) if not unicodedata.combining(c))
        assert r.n == unicodedata.normalize("NFC", r.t)
        assert r.k == re.sub(r"[\W_]+", " ", bare).strip(" ")
