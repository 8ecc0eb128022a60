"""Global ranks, splits and sums that avoid a single task, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import DEFAULT, FIXTURE
from corpusloom.operators import dedup, evaluation, fonts, quality, sft, splits, tokens
from corpusloom.operators.ranking import with_rank
from corpusloom.plans.registry import QUERIES


def test_rank_follows_the_order(spark):
    rows = [(i, random.Random(i).randint(0, 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = {r.i: r["rank"] for r in with_rank(df, F.desc("v"), F.col("i")).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert with_rank(df.limit(0), F.col("i")).count() == 0


def test_stratified_split_takes_the_smallest_hashes(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(3000)] + [(9000 + i, None) for i in range(40)] + [(9999, "one")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = {r.doc_id: r.split for r in splits.stratified_split(df).collect()}
    for source in ("big", "small", None, "one"):
        own = sorted((i for i, s in rows if s == source), key=lambda i: (hashlib.md5(f"1337|{i}".encode()).hexdigest(), i))
        v = max(min(50, len(own) // 10), int(len(own) * 0.01))
        want = {i: "val" if k < v else "test" if k < 2 * v else "train" for k, i in enumerate(own)} if 2 * v < len(own) else dict.fromkeys(own, "train")
        assert {i: got[i] for i in own} == want


@pytest.mark.parametrize("n", [1, 2, 10, 9000])
def test_sequential_split(spark, n):
    ids = random.Random(n).sample(range(10 * n), n)
    got = {r.doc_id: r.split for r in splits.sequential_split(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    assert got == {i: "train" if k < int(0.9 * n) else "val" for k, i in enumerate(sorted(ids))}


def test_block_split_and_streams(spark):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(200)], "doc_id long, ids array<int>")
    split = splits.block_split(df.select("doc_id"), block=10, fraction=0.05)
    val = sorted(r.doc_id for r in split.filter("split = 'val'").collect())
    assert len(val) == 10 and val[0] % 10 == 0 and val[-1] == val[0] + 9
    rows = tokens.block_streams(df, split, 3).orderBy("doc_id").collect()
    assert [x for r in rows if r.split == "val" for x in r.ids] == [3, *(x for i in val for x in (i, i + 1, 3))]
    assert {(r.split, r.n_messages) for r in rows} == {("val", 10), ("train", 190)}


def test_running_heads_in_long_texts(spark):
    lines = ["Head"] * 5 + ["four"] * 4 + [f"line {i} of many words here" for i in range(3000)] + ["12", "", "", "", "", ""]
    got = quality.strip_running_heads(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first().text
    assert got == "\n".join(x for x in lines if x not in ("Head", "12"))


def test_count_tokens_counts_the_unknown_token(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "t.json"))
    df = tokens.count_tokens(spark.createDataFrame([("a b zz a",)], "text string"), str(tmp_path / "t.json"))
    assert sorted((r.pos, r.word, r.n_tokens, r.n_unk) for r in df.collect()) == [(0, "a", 1, 0), (1, "b", 1, 0), (2, "zz", 1, 1), (3, "a", 1, 0)]
    assert tokens.fertility(df, special="z").first().unk_rate == 0.25


def test_translated_examples_survive_the_round_trip(spark):
    rows = [(1, "p1", "a1", [1.0, 0.0], [1.0, 0.1], 0.1), (2, "p2", "a2", [1.0, 0.0], [0.0, 1.0], 0.1), (3, "p3", "a3", [1.0, 0.0], [1.0, 0.0], 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, answer string, emb_a array<double>, emb_b array<double>, oov double")
    out = sft.translated(df, oov_col="oov").collect()
    assert [(r.doc_id, r.instruction, r.response, r.task, r.source) for r in out] == [(1, "p1", "a1", "translated", "dolly")]


def test_replay_keeps_each_source_in_order(spark):
    a = spark.createDataFrame([(f"q{i}", f"r{i}") for i in range(30)], "prompt string, completion string").coalesce(1)
    b = spark.createDataFrame([("x", "y")], "inputs string, targets string")
    out = sft.replay([a, b], 31).collect()
    assert [r.instruction for r in out] == [f"q{i}" for i in range(30)] + ["x"]
    assert [r.instruction for r in sft.replay([a, b], 3).collect()] == ["q0", "q1", "q2"]


def test_evaluation_of_a_model_in_one_row(spark):
    losses = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5)], "domain string, nll double, n_tokens int")
    said, human = (spark.createDataFrame([(t,)], "text string") for t in ("azul ɣef tura", "azul"))
    words = spark.createDataFrame([(0, "azul", 2, 0)], "pos int, word string, n_tokens int, n_unk int")
    right, wrong = (spark.createDataFrame([([0.1, 0.9], k)], "scores array<double>, answer int") for k in (1, 0))
    known = spark.createDataFrame([("azul",)], "word string")
    r = evaluation.evaluate(losses, said, human, words, wrong, known, special="ɣ", base_choices=right).first()
    assert r.tokens_per_word == 2 and r.oov_human == 0 and abs(r.oov - 2 / 3) < 1e-9 and r.purity == 1
    assert (r.accuracy, r.base_accuracy, r.forgetting.verdict) == (0, 1, "forgetting") and set(r.perplexity) == {"a", "b"}


def test_cipher_tells_emphatic_from_plain(spark):
    words = ["tara", "raki", "kara", "taki"]
    text = " ".join(words * 30).replace("r", "ô")
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    profile = fonts.letter_profile(spark.createDataFrame([(" ".join(words),)], "text string"))
    found, before, after = fonts.solve_cipher(spark.createDataFrame([(text,)], "text string"), lexicon, profile)
    assert found == {"ô": "r"} and before > 0.5 and after == 0


def test_translation_query_reads_all_pairs(spark, tmp_path):
    n = 15_001
    turns = spark.range(2 * n).select(
        F.floor(F.col("id") / 2).alias("conv_id"), (F.col("id") % 2).cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 2 == 0, "one two three four").otherwise("yan sin kraḍ kuẓ").alias("text"),
    )
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["sft_translation"](spark, str(tmp_path)).count() == 2 * n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quick_classes_hold_the_same_characters(spark):
    chars = spark.range(1, 0x3000).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for letters in ("aɣ]^-\\[é", "ab", "ɣ", FIXTURE.canonical, DEFAULT.canonical):
        own, rest = T.quick_class(letters), T.quick_class(letters, negate=True)
        got = chars.agg(F.collect_set(F.when(F.col("c").rlike(own), F.col("c"))), F.collect_set(F.when(F.col("c").rlike(rest), F.col("c")))).first()
        assert set(got[0]) == set(letters) and len(got[1]) == 0x3000 - 1 - len(set(letters))


def test_report_judges_each_document_once(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (2, "a", ""), (3, "b", "1 2"), (4, None, "")], "doc_id long, source string, text string")
    out = quality.report_by_source(quality.with_reason(df, FIXTURE))
    assert _plan(out).count("Scan ExistingRDD") == 1
    assert {(r.source, r.seen, r.kept, r.kept_words, r.top_reason) for r in out.collect()} == {("a", 2, 0, 0, "empty"), ("b", 1, 0, 0, "too_short"), (None, 1, 0, 0, "empty")}


def test_lexicon_rung_after_the_ladder(spark):
    good = "many words that stand in a row of letters"
    df = spark.createDataFrame([(1, good, 0.9), (2, good, 0.1), (3, "", 0.9)], "doc_id long, text string, oov double")
    want = quality.with_reason(df, FIXTURE, oov_col="oov").select("doc_id", "reject_reason")
    got = quality.with_lexicon_reason(quality.with_reason(df.drop("oov"), FIXTURE), df.select("doc_id", "oov"), FIXTURE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "high_oov"), (2, None), (3, "empty")]


def test_assembled_examples_are_made_once(spark):
    df = spark.createDataFrame([(i, "One two three four five six. " * 20, "s") for i in range(60)], "doc_id long, text string, source string")
    out = sft.assemble([sft.qa(df), sft.summarize(df)])
    assert "regexp" not in _plan(out) and out.filter("split = 'val'").count() == 6


def test_texts_alone_shuffle_no_words(spark):
    df = spark.createDataFrame([(1, "azul ôa"), (2, None), (3, "vava $")], "doc_id long, text string")
    out = fonts.decode_text(df, spark.createDataFrame([("ṛa",), ("azul",)], "word string"))
    assert len([x for x in _plan(out).split("\n") if "hashpartitioning" in x and "word" in x]) == 1  # the lexicon's own
    assert {r.doc_id: (r.map, r.oov) for r in out.collect()} == {1: ("map_a", 0.0), 2: ("identity", 1.0), 3: ("identity", 1.0)}


def test_chrf_shuffles_no_grams(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate([("a aba b.", "aba ab b!"), ("xx", ""), (None, "y"), ("é é ɣa, é", "é ɣa é é")])]
    out = evaluation.chrf(spark.createDataFrame(pairs, "id long, hypothesis string, reference string"))
    assert "Generate" not in _plan(out)
    sums = Counter()
    for _, a, b in pairs:
        words = [re.sub(r"([.,!])(?=\s|$)", r" \1", t or "").split() for t in (a, b)]
        for o, n, (x, y) in [*((k, k, ["".join((t or "").split()) for t in (a, b)]) for k in range(1, 7)), *((6 + k, k, words) for k in (1, 2))]:
            g, h = (Counter(tuple(z[i : i + n]) for i in range(len(z) - n + 1)) for z in (x, y))
            sums += Counter({(o, "m"): (g & h).total(), (o, "h"): g.total(), (o, "r"): h.total()})
    f = [5 * sums[o, "m"] / (4 * sums[o, "r"] + sums[o, "h"]) for o in range(1, 9) if sums[o, "h"] and sums[o, "r"]]
    assert out.first().chrf == pytest.approx(100 * sum(f) / len(f))


def test_encoding_joins_a_row_per_word_of_a_batch(spark):
    rows = [(i, t) for i, t in enumerate(["b a a c", "", None, "a zz b a", "zz"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, idx int")
    out = tokens.encode(df, vocab)
    assert "CoGroup" in _plan(out) and "pos#" not in _plan(out)
    assert {r.doc_id: r.ids for r in out.collect()} == {0: [5, 4, 4, 1], 1: [], 2: [], 3: [4, 1, 5, 4], 4: [1]}


def test_cipher_search_reads_counted_tokens(spark):
    docs = spark.createDataFrame([("$zul  $zul\nx$y-a b\u2003Σ$Σ",), ("$zul",), (None,)], "text string")
    counted = fonts.token_counts(docs)
    assert {r.text: r.n for r in counted.collect()} == {"$zul": 3, "x$y-a": 1, "b": 1, "Σ$Σ": 1}
    profile = fonts.letter_profile(docs)
    assert sorted(map(tuple, fonts.letter_profile(counted, weight="n").collect())) == sorted(map(tuple, profile.collect()))
    assert fonts.suspects(counted, profile, weight="n").collect() == fonts.suspects(docs, profile).collect()


def test_cipher_weighs_words_of_several_glyphs(spark):
    """Words of two unknown glyphs wait for the first; known letters that are suspects too are weighed by what they already spell."""
    plain = ["ɣara", "kɛra", "ɣeɛa", "roka", "ɣoka", "toto"]
    text = " ".join(plain * 20)
    lex = spark.createDataFrame([(w,) for w in plain], "word string")
    drawn = spark.createDataFrame([(text.replace("ɣ", "$").replace("ɛ", "ε"),)], "text string")
    profile = fonts.letter_profile(spark.createDataFrame([(text,)], "text string"))
    found, before, after = fonts.solve_cipher(drawn, lex, profile)
    assert found == {"$": "ɣ", "ε": "ɛ"} and after == 0 and abs(before - 4 / 6) < 1e-9
    free = spark.createDataFrame([(text.replace("ɣ", "$").replace("ɛ", "ε"), 3)], "text string, n long")
    assert fonts.solve_cipher(free, lex, profile, weight="n") == (found, before, after)


def test_fonts_share_tokens_and_lexicon(spark, monkeypatch):
    plain = ["ɣara", "kɛra", "roka"]
    rows = [(k, 0, 0, font, " ".join(plain * 200).replace("ɣ", a).replace("ɛ", b)) for k, (font, a, b) in enumerate([("Odd", "$", "ε"), ("Even", "ε", "$")])]
    spans = spark.createDataFrame(rows, "doc_id long, seq int, page int, font string, text string")
    lex = spark.createDataFrame([(w,) for w in plain], "word string")
    made = []
    monkeypatch.setattr(fonts, "_lexicons", lambda x, f=fonts._lexicons: made.append(1) or f(x))
    found = fonts.solve_fonts(spans, lex, fonts.letter_profile(spark.createDataFrame([(" ".join(plain),)], "text string")))
    assert found == {"Odd": {"$": "ɣ", "ε": "ɛ"}, "Even": {"ε": "ɣ", "$": "ɛ"}} and len(made) == 1


def test_fonts_take_counted_tokens_with_blanks(spark):
    """Tokens with blanks weigh as much as the spans, so ``min_chars`` finds the same fonts."""
    plain, rate = ["ɣara", "kɛra", "roka"], 40
    text = "  ".join(plain * rate).replace("ɣ", "$").replace("ɛ", "ε") + "\n"
    spans = spark.createDataFrame([(0, "Odd", text), (1, "Odd", None), (2, "Odd", "\u2003 \t")], "doc_id long, font string, text string")
    counted = fonts.token_counts(spans, "font", blanks=True)
    size = len(text) + 3
    usage = fonts.font_usage(counted, fonts.Registry(), weight="n").collect()
    assert usage == fonts.font_usage(spans, fonts.Registry()).collect() and usage[0].chars == size
    assert sum(r.n for r in counted.collect() if r.text.strip()) == 3 * rate
    lex = spark.createDataFrame([(w,) for w in plain], "word string")
    profile = fonts.letter_profile(lex.withColumnRenamed("word", "text"))
    for least, want in ((size, {"Odd": {"$": "ɣ", "ε": "ɛ"}}), (size + 1, {})):
        assert fonts.solve_fonts(counted, lex, profile, min_chars=least, weight="n") == want
        assert fonts.solve_fonts(spans, lex, profile, min_chars=least) == want


def test_font_query_reads_texts_once(spark, data_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(fonts, "solve_fonts", lambda spans, *a, **k: plans.append(_plan(spans)) or {})
    assert QUERIES["solve_fonts"](spark, data_dir).count() == 0
    assert len(plans) == 1 and "FileScan" not in plans[0]


def test_signatures_hold_no_arrow_batch(spark):
    docs = spark.createDataFrame([(0, "Azul fell-awen, a y imdanen"), (1, None), (2, "azul")], "doc_id long, text string")
    signed = dedup.signatures(docs)
    assert "ArrowEvalPython" not in _plan(signed) and "BatchEvalPython" in _plan(signed)
    a, b = dedup.permutations()
    got = {r.doc_id: r.signature for r in signed.collect()}
    assert got[1] == [0] * dedup.NUM_PERM
    sets = {r.doc_id: r.s for r in dedup.shingle_sets(docs).collect()}
    assert all(got[i] == [min((x * s + y) % dedup.MERSENNE for s in sets[i]) for x, y in zip(a, b, strict=True)] for i in (0, 2))


@pytest.mark.parametrize("name", ["near_dup_components", "lsh_candidate_pairs", "dedup_report"])
def test_duplicate_queries_sign_in_small_lots(spark, data_dir, monkeypatch, name):
    plans = []

    def signed(*args, real=dedup.signatures, **options):
        out = real(*args, **options)
        plans.append(_plan(out))
        return out

    monkeypatch.setattr(dedup, "signatures", signed)
    assert QUERIES[name](spark, data_dir).count()
    assert len(plans) == 1 and "BatchEvalPython" in plans[0] and "ArrowEvalPython" not in plans[0]
