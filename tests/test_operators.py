"""Operators over small tables: deduplication, splits, packing, instruction data, fonts, evaluation, sources."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.profile import FIXTURE
from corpusloom.operators import chat, dedup, evaluation, fonts, lexicon, parallel, quality, sft, splits, tokens
from corpusloom.plans.registry import QUERIES
from corpusloom.sources import readers, writers
from corpusloom.streaming import stream


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


# --- deduplication


def test_exact_dedup_folds_case_accents_and_marks(spark):
    df = docs(spark, ["Azul fell-awen!", "azul FELL awen", "other", "àzul fell awen", None, ""])
    got = {r.doc_id: r.first_id for r in dedup.exact_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4}


def test_signature_rows_must_divide():
    with pytest.raises(ValueError, match="multiple"):
        dedup.candidate_pairs(None, bands=15)


def test_near_duplicates_keep_component_minima(spark):
    base = [f"word{i}" for i in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    far = [f"other{i}" for i in range(200)]
    df = docs(spark, [" ".join(far), " ".join(base), " ".join(near), " ".join(base).upper(), "short text", ""])
    rows = {r.doc_id: r for r in dedup.near_duplicate_components(df).collect()}
    assert [rows[i].component_id for i in range(6)] == [0, 1, 1, 1, 4, 5]
    report = dedup.dedup_report(dedup.near_duplicate_components(df)).first()
    assert (report.total, report.exact_removed, report.near_removed, report.kept) == (6, 1, 1, 4)
    assert {r.doc_id for r in dedup.survivors(df).collect()} == {0, 1, 4, 5}


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.range(n).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 20], "head long, doc_id long")
    got = {r.doc_id: r.component_id for r in dedup.connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(n)}


# --- splits


@pytest.mark.parametrize(("n", "held_out"), [(1, 0), (9, 0), (10, 1), (500, 50), (5_000, 50), (10_000, 100)])
def test_stratified_split_sizes(spark, n, held_out):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    by = {r.split: r["count"] for r in splits.stratified_split(df).groupBy("split").count().collect()}
    assert by.get("val", 0) == by.get("test", 0) == held_out and sum(by.values()) == n


def test_weighted_copies(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    w = spark.createDataFrame([("s0", 0.25), ("s1", 2.0), ("s2", 1.5)], "source string, weight double")
    by = {r.source: r["count"] for r in splits.weighted_copies(df, w).groupBy("source").count().collect()}
    assert by["s1"] == 2000 and by["s3"] == 1000 and abs(by["s0"] - 250) < 60 and abs(by["s2"] - 1500) < 60


def test_prefix_includes_the_crossing_document(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"))
    assert splits.prefix_by_chars(df, 95).count() == 10 and splits.prefix_by_chars(df, 100).count() == 10 and splits.prefix_by_chars(df, 60_001).count() == 6001


def test_block_split_keeps_blocks_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    rows = splits.block_split(df, block=50, fraction=0.1).collect()
    val = {r.doc_id // 50 for r in rows if r.split == "val"}
    assert len(val) == 2 and sum(r.split == "val" for r in rows) == 100


def test_interleave_shares(spark):
    a, b = (spark.range(n).withColumnRenamed("id", "doc_id") for n in (100, 10))
    by = {r.stream: r["count"] for r in splits.interleave({"a": (a, 0.5), "b": (b, 0.5)}, 100).groupBy("stream").count().collect()}
    assert by == {"a": 50, "b": 50}


# --- tokens


def test_pack_blocks_and_windows(spark):
    ids = [[1, 2, 3], [], [4], list(range(5, 15))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")
    flat = [x for s in ids for x in s]
    blocks = {r.block: r.input_ids for r in tokens.pack_blocks(df, 4).collect()}
    assert blocks == {b: flat[4 * b : 4 * b + 4] for b in range(len(flat) // 4)}
    wins = {r.window: (r.x, r.y) for r in tokens.shifted_windows(df, 4).collect()}
    assert wins == {b: (flat[4 * b : 4 * b + 4], flat[4 * b + 1 : 4 * b + 5]) for b in range((len(flat) - 1) // 4)}
    for r in tokens.random_windows(df, 5, 8).collect():
        assert r.x == flat[r.start : r.start + 5] and r.y == flat[r.start + 1 : r.start + 6]


def test_separator_stream(spark):
    df = spark.createDataFrame([(0, [5]), (1, [6, 7])], "doc_id long, ids array<int>")
    assert [r.ids for r in tokens.stream_with_separator(df, 9).orderBy("doc_id").collect()] == [[9, 5], [9, 6, 7, 9]]


def test_mask_and_pad(spark):
    df = spark.createDataFrame([(0, [1, 2], [3, 4]), (1, [1, 2, 3, 4, 5], [6])], "doc_id long, prompt_ids array<int>, response_ids array<int>")
    rows = {r.doc_id: r for r in tokens.pad_batches(tokens.mask_prompt(df, max_len=5), batch=2).collect()}
    assert rows[0].input_ids == [1, 2, 3, 4, 0] and rows[0].labels == [-100, -100, 3, 4, -100] and rows[0].attention_mask == [1, 1, 1, 1, 0]
    assert rows[0].trainable and not rows[1].trainable


def test_vocabulary_and_unknowns(spark):
    df = docs(spark, ["b a a c", "a b d"])
    vocab = tokens.vocabulary(df)
    assert [(r.token, r.idx) for r in vocab.orderBy("idx").collect()] == [("a", 4), ("b", 5)]
    assert {r.doc_id: r.ids for r in tokens.encode(df, vocab).collect()} == {0: [5, 4, 4, 1], 1: [4, 5, 1]}


def test_bpe_merges_by_count(spark):
    _, merges = tokens.train_bpe(docs(spark, ["aab aab", "aab ab"]), 258)
    assert merges == [("61", "62"), ("61", "6162")]


def plain_bpe(texts, size, least):
    """Merges counted anew over all pre-tokens at each step; the texts hold ASCII letters and spaces only."""
    words = Counter(tuple(f"{b:02X}" for b in w.encode()) for t in texts for w in re.findall(r" ?[A-Za-z]+|\s+", t or ""))
    vocab, merges = {f"{i:02X}" for i in range(256)}, []
    while len(vocab) < size:
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        top = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if top is None or pairs[top] < least:
            break
        merges.append(top)
        vocab.add("".join(top))
        fresh = Counter()
        for w, n in words.items():
            out = []
            for x in w:
                out[-1:] = [out[-1] + x] if out and (out[-1], x) == top else [*out[-1:], x]
            fresh[tuple(out)] += n
        words = fresh
    return merges


def test_bpe_merges_read_all_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aabcde") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(30)] + [None, "", "aaaaaaa aaaa"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "zz zz zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.a, r.b) for r in QUERIES["bpe_merges"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == plain_bpe(texts, 12_000, 5) and len(got) > 12
    vocab, merges = tokens.train_bpe(docs(spark, texts), 12_000)
    assert merges == plain_bpe(texts, 12_000, 2) and len(vocab) == len(set(vocab)) == len({*vocab[:256], *(a + b for a, b in merges)})


# --- instruction data


def test_conjugation_skips_blank_forms(spark):
    verbs = spark.createDataFrame([(0, "ddu", ["a", None, ""], None, "x"), (1, "", ["a"], ["b"], "y")], "doc_id long, lemma string, aorist array<string>, preterite array<string>, participle string")
    got = sft.conjugation(verbs).collect()
    assert sorted(r.response for r in got) == ["- a", "x"] and all("ddu" in r.instruction for r in got)


def test_examples_and_messages(spark):
    text = "Azul fell-awen a yimdanen n tmurt. Tamurt-nneɣ d tin yelhan maḍi ass-a ɣef wayen nniḍen akk. " * 6
    df = docs(spark, [text, "short."])
    one = sft.qa(df).collect()
    assert len(one) == 1 and "Azul fell-awen" in one[0].instruction
    msgs = sft.messages(sft.qa(df)).first().messages
    assert [m.role for m in msgs] == ["system", "user", "assistant"]
    fixed = sft.spelling(df).first()
    assert fixed.response != fixed.instruction and "ɣ" in fixed.response + text
    assert sft.replay_rows(80) == 20


def test_replay_budget_is_global(spark):
    a = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "prompt string, response string")
    b = spark.createDataFrame([([("user", "q"), ("assistant", "x")],)], "messages array<struct<role:string,content:string>>")
    assert {r.instruction for r in sft.replay([a, b], 3).collect()} == {"p1", "p2", "q"}


# --- pairs


PAIRS = [("", "azul fell ak", "empty_side"), ("a b c", "azul fell", "target_length"), ("a " * 20, "azul fell ak", "length_mismatch"), ("The cat sat", "the cat sat", "untranslated"), ("a b c d", "xx yy zz", "target_not_kabyle"), ("a b c d", "azul ɣef ḥemmu", None)]


def test_pair_ladder(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(PAIRS)], "i int, s string, t string")
    got = [r.reason for r in df.select("i", parallel.pair_reason(F.col("s"), F.col("t")).alias("reason")).orderBy("i").collect()]
    assert got == [p[2] for p in PAIRS]


def test_conversations_and_translations(spark):
    nested = spark.createDataFrame([([("human", "ɣef taddart"), ("gpt", None), ("gpt", "hello")],)], "conversations array<struct<from:string,value:string>>")
    turns, dropped = parallel.flatten_conversations(nested)
    assert [r.text for r in turns.collect()] == ["ɣef taddart"] and dropped.first().dropped == 2
    rows = spark.createDataFrame([(("x", "azul"),), (("y", None),)], "translation struct<en:string,kab:string>")
    assert [r.text for r in parallel.pull_translation(rows, ("kab",)).collect()] == ["azul"]
    maps = spark.createDataFrame([({"kab": "azul"},), ({"en": "x"},)], "translation map<string,string>")
    assert [r.text for r in parallel.pull_translation(maps, ("kab",)).collect()] == ["azul"]


def test_load_pairs_skips_noisy_and_caps(spark):
    df = spark.createDataFrame([(i, f"hello there friend {i}", "azul ɣef ḥemmu ɛli") for i in range(5)], "pair_id long, en string, kab string")
    out = parallel.load_pairs([("good", "high", df), ("bad", "noisy", df), ("none", "high", df.drop("en"))], cap=3)
    assert out.count() == 3 and {r.source for r in out.collect()} == {"good"}


def test_round_trip(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0], 0.1), (1, [1.0, 0.0], [0.0, 1.0], 0.1), (2, [1.0, 0.0], [1.0, 0.0], 0.9), (3, [0.0, 0.0], [1.0, 0.0], 0.0)], "id int, emb_a array<double>, emb_b array<double>, oov double")
    assert [r.keep for r in parallel.round_trip_filter(df, oov_col="oov").orderBy("id").collect()] == [True, False, False, False]


# --- lexicon and fonts


def test_lexica(spark):
    lines = spark.createDataFrame([("# c",), ("12",), ("Azul/AB",), ("",), ("ɛli",)], "value string")
    assert {r.word for r in lexicon.from_hunspell(lines).collect()} == {"azul", "ɛli"}
    rates = {r.doc_id: r.oov for r in lexicon.oov_rates(docs(spark, ["azul x", "", None]), lexicon.from_hunspell(lines), "doc_id").collect()}
    assert rates == {0: 0.5, 1: 1.0, 2: 1.0}
    table = spark.createDataFrame([("ddu", ["yedda", "tedda"])], "lemma string, forms array<string>")
    assert {r.word for r in lexicon.from_columns(table).collect()} == {"ddu", "yedda", "tedda"}


def test_decoding_spans(spark):
    rows = [(1, 0, 1, "X+Tayma", "ùef ime§§i"), (1, 1, 1, "", "\n"), (1, 2, 1, "Y+AmazighBangle", "aîas"), (1, 3, 1, "", "\n"), (1, 4, 2, "Other", "plain"), (1, 5, 2, "", "\n")]
    spans = spark.createDataFrame(rows, "doc_id long, seq int, page int, font string, text string")
    assert fonts.decode_spans(spans).first().text == "ɣef imeṭṭi\naṭas\nplain"
    lex = spark.createDataFrame([("ɣef",), ("imeṭṭi",), ("aṭas",), ("plain",)], "word string")
    best = {r.font: r.map for r in fonts.discover_maps(spans, lex).collect()}
    assert best == {"X+Tayma": "map_b", "Y+AmazighBangle": "map_a", "Other": "identity"}
    report = fonts.decode_report(spans, fonts.decode_spans(spans), lex).first()
    assert report.pages == 2 and report.oov_after == 0 < report.oov_before


def test_cipher_search_recovers_a_glyph(spark):
    words = ["ɣef", "aɣrum", "ɣer", "imezdaɣ", "taɣawsa", "ɣur", "yeɣra", "azul", "taddart", "axxam"]
    plain = " ".join(words * 20)
    lex = spark.createDataFrame([(w,) for w in words], "word string")
    freq = fonts.letter_profile(docs(spark, [plain]))
    table, before, after = fonts.solve_cipher(docs(spark, [plain.replace("ɣ", "$")]), lex, freq)
    assert table == {"$": "ɣ"} and before > 0.5 and after == 0
    assert [r.glyph for r in fonts.suspects(docs(spark, [plain.replace("ɣ", "$") + " , . ;"]), freq).collect()] == ["$"]


def test_cipher_tries_every_suspect(spark):
    odd = [chr(0x2200 + i) for i in range(41)]  # mathematical signs, the last one the rarest
    lex = spark.createDataFrame([("aɣrum",)], "word string")
    freq = fonts.letter_profile(docs(spark, ["aɣrum"]))
    text = " ".join(f"x{g}y" for g in odd[:-1] for _ in range(6)) + f" a{odd[-1]}rum" * 5
    assert fonts.suspects(docs(spark, [text]), freq).count() == 41
    assert fonts.solve_cipher(docs(spark, [text]), lex, freq, max_rounds=1)[0] == {odd[-1]: "ɣ"}


# --- evaluation


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0, 11), ("a", 3.0, 11), ("b", 9.0, 1)], "domain string, nll double, n_tokens int")
    got = {r.domain: r.perplexity for r in evaluation.perplexity(rows, "domain").collect()}
    assert got["a"] == pytest.approx(math.exp(2)) and got["b"] == math.inf
    pair = spark.createDataFrame([(0, "the cat sat", "the cat sat"), (1, "abc", "abc")], "id int, hypothesis string, reference string")
    assert evaluation.chrf(pair).first().chrf == pytest.approx(100)
    assert evaluation.chrf(pair.limit(0)).first().chrf == 0
    lr = spark.range(1).select(*(evaluation.learning_rate(F.lit(s), peak=1.0, floor=0.1, warmup=10, total=110).alias(f"s{s}") for s in (0, 9, 10, 110))).first()
    assert (lr.s0, lr.s9, lr.s10, lr.s110) == (pytest.approx(0.1), pytest.approx(1.0), pytest.approx(1.0), pytest.approx(0.1))


# --- reports, sources, sinks, streams


def test_report_adds_up(spark, data_dir):
    judged = quality.with_reason(spark.read.parquet(f"{data_dir}/documents.parquet"), FIXTURE)
    row = quality.reason_counts(judged).first()
    assert row.seen == row.kept + sum(row.rejected.values())


def test_sources(spark, tmp_path):
    spark.createDataFrame([("ɣef taddart", 1), (" ", 2)], "sentence string, n int").write.json(f"{tmp_path}/a.jsonl")
    good = readers.Source("a", "mono", f"{tmp_path}/a.jsonl")
    pool = readers.load_pool(spark, readers.build_pool([good, readers.Source("gone", "mono", f"{tmp_path}/none.jsonl"), readers.Source("p", "pdf", "x")]))
    assert [(r.source, r.text) for r in pool.collect()] == [("a", "ɣef taddart")]
    wide = spark.createDataFrame([("x", "long text here")], "a string, b string")
    assert readers.text_column(wide) == "b" and readers.text_column(wide, "a") == "a"
    assert readers.registry_table(spark, [good]).first().weight == 1.0
    assert readers.find_files(spark, [str(tmp_path)], "a.jsonl").endswith("a.jsonl")
    (tmp_path / "t.txt").write_text("one two\n\nthree " + "w " * 900)
    got = readers.local_documents(spark, [f"{tmp_path}/t.txt"]).orderBy("part", "chunk").collect()
    assert [len(r.text.split()) for r in got] == [2, 400, 400, 101]


def test_sinks(spark, tmp_path):
    df = docs(spark, [f"text {i}" for i in range(60)])
    n = {r.split: r.n for r in writers.write_splits(df, splits.stratified_split(df), f"{tmp_path}/s").collect()}
    assert spark.read.json(f"{tmp_path}/s").count() == 60 == sum(n.values())
    writers.write_report(f"{tmp_path}/r", totals=df.agg(F.count("*").alias("documents")))
    assert spark.read.json(f"{tmp_path}/r").first().totals[0].documents == 60
    cleaned = chat.clean_messages(df.withColumnRenamed("text", "line"))
    assert chat.cleaning_stats(cleaned).first().kept == 60 and chat.chat_stream(cleaned, block=10).count() == 60


def test_stream(spark, tmp_path):
    docs(spark, ["yenna-yas ɣef taddart n yimezdaɣ", "x", "x"]).write.parquet(f"{tmp_path}/in")
    out = stream.clean_stream(stream.read_document_stream(spark, f"{tmp_path}/in"))
    q = out.select("doc_id", "reject_reason").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.reject_reason for r in spark.sql("select * from cleaned").collect()} == {0: None, 1: "too_short", 2: "too_short"}
    q = stream.distinct_stream(stream.read_document_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("distinct_docs").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from distinct_docs").count() == 2
