"""Each operator against a plain Python version, plus the defined edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import decontam, line_dedup, minhash, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_shards, warc  # noqa: E402
from corpusloom.llm._wordbpe import word_bpe_path  # noqa: E402
from corpusloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, label string, cls long, anchor int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 12}" if "source" not in more else more["source"], None if t is None else len(t), "x", "y", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    return [None, "", " \n\t ", "a", "a", "b " * 3, "é" * 500, "x" * 5000, "\x01\x02 a@b.co \x01", "\n".join(["same line here"] * 6)]


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


# --- personal data


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(t):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def check_pii(df, texts):
    rows = df.collect()
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert not set(filter(None, digest.split(","))) - set(r.spans.split(","))
    return rows


def test_pii_matches_regular_expressions(documents, texts):
    assert len(check_pii(pii.find_personal_data(documents), texts)) == len(texts)


def test_pii_tricky_matches(spark):
    tricky = odd_texts() + [
        "a@b.co-m@x.y a@b.co_m@x.y a@b.co%z@q.r @x.y a@b a@b. ..@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 1 2 3",
        "+1 (988) 555-2485. +12 34 +1234567890123456 +1 2 3 4 5 6 7 8 9 +", "é😀 a@b.co 😀+1 988 555 2485", "9" * 3000, "a." * 2000 + "@b.c", "1.2.3.4 " * 500,
    ]
    check_pii(pii.find_personal_data(docs_of(spark, tricky)), {i: (t or "") for i, t in enumerate(tricky)})


def test_pii_bootstrap_finds_unseen(spark):
    rows = [f"please send it to contact email: user{i}@site{i}.example.com today" for i in range(20)] + ["please send it to contact email: user7(at)hidden-site today", "no identifiers at all 77"]
    out = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert out[20].n_email == 0 and out[20].n_found == 1 and out[20].spans == "email:33:53"
    assert out[21].spans == "" and out[0].n_email == 1 and out[0].n_found == 0


def test_pii_one_word_and_right_contexts_and_secrets(spark):
    key = "0123456789abcdef0123456789abcdef"
    rows = [f"fax +1 (212) 555-01{i:02d} end tel +1 (212) 555-02{i:02d} please" for i in range(20)] + ["fax 555-0199 end tel 555-0198 please"]
    rows += [f'w{chr(97 + i)} {chr(97 + i)}x token = "{key[i:]}{key[:i]}" z' for i in range(20)] + ['q q token = "hunter2" q', "version 2.0 of it, chapter 17", key.replace("9", "g")]
    out = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert out[20].spans == "phone:4:12,phone:21:29" and out[20].n_found == 2 and out[20].n_spans == 2
    assert out[21].n_secret == 1 and out[21].spans == "secret:15:47"
    assert out[41].spans == "secret:13:20" and out[41].n_secret == 0 and out[41].n_found == 1
    assert out[42].n_spans == out[43].n_spans == 0
    plain = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows), bootstrap=False).collect()}
    assert plain[20].n_spans == plain[41].n_spans == 0 and plain[0].n_spans == 2


def test_pii_of_a_text_with_many_matches(spark):
    text = "1.2.3.4 a@b.co\n" * 5000
    row = pii.find_personal_data(docs_of(spark, [text])).collect()[0]
    assert (row.n_ip, row.n_email) == (5000, 5000) and row.spans.split(",")[-1] == f"ip:{15 * 4999}:{15 * 4999 + 7}"


# --- quality rules


def quality_counts(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, documents, texts):
    more = odd_texts() + ["w " * 100, "f\x0bf\x0cf f", "a b c d e f g h i a b c d e f g h i " * 3]
    for df, want in ((documents, texts), (docs_of(spark, more), dict(enumerate(t or "" for t in more)))):
        for r in quality_rules.judge_quality(df).collect():
            c = quality_counts(want[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
            assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
            assert not (r.kept and r.base_failed)


def test_quality_thresholds_adapt(spark):
    clean = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(100)]
    out = quality_rules.keep_quality(docs_of(spark, [*clean, " ".join(f"***{j}***" for j in range(60))], source="one")).collect()
    assert {r.doc_id for r in out} == set(range(100)) and out[0].sig == "x"


def test_quality_stage_keeps_given_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 3 else "x", None if i % 2 else "en", f"s{i % 2}", -5, "mine", 7, 8) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string, cut_symbols int, g_lang int")
    out = quality_rules.keep_quality(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(str(r) for r in df.collect() if r.doc_id % 3)


def test_quality_null_groups_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, " ".join(map(str, range(30)))), (None, "en", None, None)], "doc_id long, lang string, source string, text string")
    assert {r.doc_id: r.kept for r in quality_rules.judge_quality(df).collect()} == {1: True, None: False}
    assert quality_rules.judge_quality(df.limit(0)).count() == 0


# --- line dedup


def test_line_dedup(spark):
    texts = [f"menu home\nown {i}\n  menu home \n" for i in range(24)] + odd_texts()
    rows = line_dedup.line_report(docs_of(spark, texts)).collect()
    sites, first = defaultdict(set), {}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            k = line.strip(" \t\n\x0b\f\r")
            if k:
                sites[k].add(i % 12)
                first.setdefault(k, (i, p))
    for r in rows:
        lines = (texts[r.doc_id] or "").split("\n")
        key = [x.strip(" \t\n\x0b\f\r") for x in lines]
        left = [x for p, (x, k) in enumerate(zip(lines, key, strict=True)) if not (k and len(sites[k]) >= 10 and first[k] != (r.doc_id, p))]
        assert r.n_removed == len(lines) - len(left) and r.kept_sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest()
    kept = line_dedup.remove_boilerplate(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in kept} == set(range(len(texts))) and next(r for r in kept if r.doc_id == 3).text == "own 3\n"
    assert line_dedup.line_report(docs_of(spark, ["x"]).limit(0)).count() == 0


# --- MinHash


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = Counter((a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :])
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_texts(seed=3):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    return out + odd_texts()


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_components(spark, documents, texts, k):
    made = near_texts()
    for df, want in ((docs_of(spark, made), dict(enumerate(made))), (documents, texts)):
        expect = brute_components(want, k, 80)
        rows = minhash.near_duplicates(df, shingle_words=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expect
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_chain_and_edges(spark):
    words = [f"t{i}" for i in range(400)]
    chain = [" ".join(f"q{j}" if j < 8 * step else words[j] for j in range(400)) for step in range(12)]
    out = minhash.near_duplicates(docs_of(spark, chain), shingle_words=4).collect()
    assert {r.component_id for r in out} == {0}
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "zz"), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle_words=4).collect()), key=str)
    assert rows == sorted([(None, 3, 5), (5, 3, 5), (5, 1, 5), (None, 0, None)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert [r.doc_id for r in minhash.drop_near_duplicates(docs_of(spark, ["a b c d e f g"] * 3)).collect()] == [0]


def test_near_duplicates_of_a_repeated_id(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "other words stand in this text"), (3, None), (4, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()}
    assert got == {rows[0], rows[2], rows[3]}
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (7, "only this id has these few words"), (None, "no id but a text of its own"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("c"))
    got = {(r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()}
    assert got == {rows[0], rows[4], rows[5], rows[6]}


def test_minhash_prune_bound():
    least = minhash.least_matches()
    assert sorted(least) == [32, 64, 96, 128, 160] and all(least[n] < 0.8 * n for n in least)


# --- decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randint(0, 900)}" for _ in range(rng.choice([6, 20, 45])))) for i in range(25)] + [(99, "one two"), (100, None)]
    texts = []
    for i in range(120):
        w = [f"v{rng.randint(0, 900)}" for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            item = items[i % 25][1].split()
            for _ in range(rng.randint(0, int(0.2 * len(item)))):
                kind, at = rng.randrange(3), rng.randrange(len(item))
                item[at : at + (kind != 2)] = [] if kind == 1 else [f"n{rng.randint(0, 99)}"]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in item]
        texts.append(" ".join(w))
    texts += odd_texts()
    want = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for item, body in items:
            target = (body or "").split()
            if len(target) >= 5:
                row = [0] * (len(words) + 1)
                for a, x in enumerate(target, 1):
                    new = [a]
                    for b, y in enumerate(words, 1):
                        new.append(min(row[b - 1] + (x != y), row[b] + 1, new[-1] + 1))
                    row = new
                if min(row) <= int(0.2 * len(target) + 1e-9):
                    want[i, item] = min(row)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(docs_of(spark, texts), bench).collect()}
    assert not set(got) - set(want)
    assert len(set(want) - set(got)) <= 0.02 * len(want) and all(want[k] <= got[k] for k in got)
    assert all(k in got for k, d in want.items() if d == 0)
    assert decontam.leaks(docs_of(spark, texts).limit(0), bench).count() == 0
    assert decontam.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0
    kept = {r.doc_id for r in decontam.drop_leaks(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {k[0] for k in got}


def test_walk_recall():
    assert decontam.calibrate(30, 6, 0.99) <= 256
    item = np.arange(1, 31).astype(np.uint64)
    assert decontam.lsh_equal(item[None, :], item, 1).all()
    assert decontam.best_distance(np.array([9, 1, 2, 4, 9]).astype(np.uint64), np.array([1, 2, 3, 4]).astype(np.uint64)) == 1


def test_decontamination_of_short_items(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "one two"), (4, "one two three four"), (5, "..."), (6, None)], "item_id long, text string")
    texts = ["x One, two three four y", "two one x two", "one two three five", "x"]
    df = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(df, bench).collect()}
    assert got == {(0, 1, 0), (0, 2, 0), (0, 4, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, min_words=3).collect()} == {(0, 4)}
    assert {r.doc_id for r in decontam.drop_leaks(df, bench).collect()} == {3}
    rows = [(1, "x"), (1, "one two three four"), (None, "one two three four"), (None, "y"), (2, None)]
    same = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontam.drop_leaks(same, bench).collect()} == {rows[0], rows[3], rows[4]}


@pytest.mark.parametrize("target", [1.0, 0.995])
def test_decontamination_of_long_items(spark, target):
    rng = random.Random(9)
    items, texts, want = [], [], {}
    for m in (59, 80, 100, 150):
        item, edits = [f"w{m}x{i}" for i in range(m)], m // 5
        items.append((m, " ".join(item)))
        bounds = np.linspace(0, m, edits + 2).astype(int)
        for trial in range(20):
            parts = [item[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for part in parts[1:] if trial % 2 else parts[:-1]:  # one block is left intact
                at = rng.randrange(len(part))
                part[at : at + 1] = [] if trial % 4 < 2 else ["new", part[at]] if trial % 2 else [part[at], "new"]
            want[len(texts), m] = edits
            noise = [f"n{rng.randint(0, 900)}" for _ in range(2 * m)]
            texts.append(" ".join(noise[:m] + [w for part in parts for w in part] + noise[m:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(docs_of(spark, texts), bench, target_recall=target)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    assert got == want if target == 1 else len(got) >= 0.98 * len(want)
    assert decontam.calibrate(100, 20) == 0 and decontam.calibrate(30, 6, 0.99) > 0


# --- exact substrings


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(8)
    passages = ["".join(rng.choices("abc déf", k=rng.choice([90, 99, 100, 101, 180, 400]))) for _ in range(8)]
    texts = ["".join(rng.choices("xyz\n", k=rng.randint(0, 80))) + rng.choice(passages) + rng.choice(passages) + "".join(rng.choices("uvw", k=rng.randint(0, 300))) for _ in range(60)]
    texts += [*odd_texts(), "x" * 300, "ab" * 200, texts[0], texts[1]]
    want = brute_repeats(list(enumerate(texts)))
    for hot in (suffix_dedup.HOT_REGIONS, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
        assert got == want
    assert suffix_dedup.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_suffix_dedup_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "k" * 50 + "m" * 100), (1, "k" * 50 + "m" * 100), (None, "m" * 120)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(120, 120), (150, 0), (150, 150)]


def test_suffix_array_orders_suffixes():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randint(0, rng.choice([0, 1, 3, 200])) for _ in range(rng.randint(1, 120))], np.int16)
        order = suffix_dedup.suffix_array(t, 200)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = suffix_dedup.common_prefixes(t, order, 200)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :].tolist(), t[order[k] :].tolist()
            assert lcp[k] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# --- token shards


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    out = token_shards.feistel(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n)) and (n < 100 or out.tolist() != list(range(n)))
    assert (token_shards.feistel(np.arange(n), n) == out).all()


def test_token_shards_round_trip(spark, documents, texts):
    for df, want in ((documents, texts), (docs_of(spark, odd_texts()), dict(enumerate(odd_texts())))):
        index, folder = token_shards.write_shards(df, seq_len=256, shard_sequences=64)
        rows = token_shards.read_shards(index, folder, seq_len=256).collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert all(r.shard == r.slot // 64 and r.byte_offset == r.slot % 64 * 512 for r in rows)
        parts = defaultdict(list)
        for r in rows:
            at = 0
            for d in r.docs:
                parts[d.doc_id].append((d.start, r.input_ids[at : at + d.length]))
                at += d.length
            assert all(x == token_shards.PAD_ID for x in r.input_ids[at:])
        tok = tokenizer()
        for i, t in want.items():
            ids = [x for _, p in sorted(parts[i]) for x in p]
            assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, token_shards.END_ID]
        assert token_shards.sequence_digest(index, folder, seq_len=256).filter("not intact").count() == 0
    index, _ = token_shards.write_shards(documents.limit(0))
    assert index.count() == 0


# --- WARC


def test_warc_round_trip(spark, data_dir):
    pages = spark.createDataFrame(
        [(1, "http://a", "same"), (2, None, "same"), (3, "http://c", ""), (4, "http://d\n", None), (5, "u", "é\r\n\r\nWARC/1.1"), (6, "u", "x" * 3_000_000), (7, "u", "same")], "page_id long, url string, html string"
    )
    for df in (pages, spark.read.parquet(f"{data_dir}/pages.parquet")):
        want = {r.page_id: (r.html or "").encode() for r in df.collect()}
        last = {}
        for p in sorted(want):
            last[want[p]] = p
        rows = warc.archive_round_trip(df).collect()
        assert len(rows) == len(want)
        for r in rows:
            body = want[r.page_id]
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if last[body] == r.page_id else ("revisit", last[body]))
            assert r.payload_sha1 == (hashlib.sha1(body).hexdigest() if r.record_type == "response" else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_members_and_broken_streams(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame([(i, "u", f"body {i}" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    rough = warc.write_archives(pages, folder).cache()
    path = rough.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    own = rough.filter(rough.path == rough.first().path)
    index = sorted(warc.normalise_gzip(own).collect(), key=lambda r: r.offset)
    whole = open(index[0].path.removeprefix("file://"), "rb").read()
    at = 0
    for r in index:
        assert r.offset == at
        record = zlib.decompress(whole[at : at + r.length], 31)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at += r.length
    assert at == len(whole) and zlib.decompress(data, 31) == b"".join(zlib.decompress(whole[r.offset : r.offset + r.length], 31) for r in index)
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception, match="cut short|inside a record"):
        warc.normalise_gzip(rough).collect()


# --- packing


def test_packing_with_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, said = public_tokenizers.path("byte_bpe_50k.json"), odd_texts() + ["Two Words, it's  here", "<|endoftext|> x"]
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs_of(spark, said), tokenizer_path=path).orderBy("doc_id", "start").collect()
    for i, t in enumerate(said):
        assert [x for r in rows if r.doc_id == i for x in r.input_ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing_of_added_tokens_and_marks(spark):
    said = ["<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>'x <|endoftext|>'x", "don't Don'T 's ''s !'s", "É. é., x́! ña×. a÷, 12.34 ab12cd -- <b>x</b> \x00a", "日本語。テスト ١٢٣ Ⅷ ½", "a\x85b\u3000c\xa0"]
    tok = tokenizer()
    rows = packing.pack_documents(docs_of(spark, said)).orderBy("doc_id", "start").collect()
    for i, t in enumerate(said):
        assert [x for r in rows if r.doc_id == i for x in r.input_ids] == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_packing(spark, documents, texts):
    tok = tokenizer()
    for df, want in ((documents, texts), (docs_of(spark, odd_texts()), dict(enumerate(odd_texts())))):
        rows = packing.pack_documents(df).collect()
        assert len({r.sequence_id for r in rows}) == len(rows)
        parts = defaultdict(list)
        for r in rows:
            assert r.length == len(r.input_ids) == 1 << r.bucket and r.length <= 2048 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes())
            parts[r.doc_id].append(r)
        for i, t in want.items():
            own = sorted(parts[i], key=lambda r: r.start)
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            assert [x for r in own for x in r.input_ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert [r.length for r in own] == packing.piece_lengths(len(ids))
    assert packing.pack_documents(documents.limit(0)).count() == 0


# --- quality classifier


def test_quality_classifier_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.score_documents(d).join(lab, "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in rows) / len(rows)
    assert right > 0.95
    assert sum(r.kept for r in rows if r.quality) / sum(1 for r in rows if r.quality) > 0.97


def test_quality_classifier_edges(spark):
    out = {r.doc_id: r for r in quality_classifier.score_documents(docs_of(spark, odd_texts())).collect()}
    assert len(out) == len(odd_texts()) and not out[0].kept and out[0].score == 0
    assert quality_classifier.score_documents(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_label_model_orders_patterns():
    k = len(quality_classifier.LABELLERS)
    good, bad = sum(3**j for j in range(k)), 0
    post, fitted = quality_classifier.fit_labellers(np.array([good, bad]), np.array([90.0, 10.0]))
    assert post[0] > 0.99 and post[1] < 0.01 and 0.8 < fitted["prior"] < 0.95


def test_label_model_equals_plain_em():
    rng = random.Random(4)
    k, truth = len(quality_classifier.LABELLERS), {}
    for _ in range(400):
        good = rng.random() < 0.7
        votes = tuple(2 if rng.random() < 0.3 else int(good) if rng.random() < 0.85 else int(not good) for _ in range(k))
        truth[votes] = truth.get(votes, 0) + 1
    patterns = list(truth)
    post = {}
    for v in patterns:
        good, bad = v.count(1), v.count(0)
        post[v] = (good + 0.5) / (good + bad + 1) * (0.5 if bad else 1)
    for _ in range(100):
        total = sum(truth.values())
        ones = sum(n * post[v] for v, n in truth.items())
        prior = (ones + 1) / (total + 2)
        share = {}
        for c in (0, 1):
            weight = {v: n * (post[v] if c else 1 - post[v]) for v, n in truth.items()}
            for j in range(k):
                for x in range(3):
                    share[c, j, x] = (sum(w for v, w in weight.items() if v[j] == x) + 1) / (sum(weight.values()) + 3)
        new = {}
        for v in patterns:
            p1, p0 = prior, 1 - prior
            for j in range(k):
                p1, p0 = p1 * share[1, j, v[j]], p0 * share[0, j, v[j]]
            new[v] = p1 / (p1 + p0)
        if max(abs(new[v] - post[v]) for v in patterns) < 1e-9:
            break
        post = new
    codes = np.array([sum(x * 3**j for j, x in enumerate(v)) for v in patterns])
    got, _ = quality_classifier.fit_labellers(codes, np.array([float(truth[v]) for v in patterns]))
    assert np.allclose(got, [post[v] for v in patterns], atol=1e-8)


def test_scorer_equals_plain_gradient_steps():
    rng = random.Random(6)
    features = [np.array(sorted(rng.sample(range(30), 5)), np.int32) for _ in range(60)]
    weights = [np.array([rng.random() for _ in f], np.float32) for f in features]
    target = np.array([float(min(f) < 4) * 0.9 + 0.05 for f in features])
    w, speed, bias, moved = [0.0] * 30, [0.0] * 30, 0.0, 0.0
    share = sum(t >= 0.5 for t in target) / len(target)
    for _ in range(quality_classifier.STEPS):
        grad, lean = [quality_classifier.DECAY * x for x in w], quality_classifier.DECAY * bias
        for f, x, t in zip(features, weights, target, strict=True):
            z = sum(w[i] * float(v) for i, v in zip(f, x, strict=True)) + bias
            error = (1 / (1 + np.exp(-z)) - t) * (0.5 / share if t >= 0.5 else 0.5 / (1 - share)) / len(target)
            lean += error
            for i, v in zip(f, x, strict=True):
                grad[i] += error * float(v)
        speed = [0.9 * s - quality_classifier.RATE * g for s, g in zip(speed, grad, strict=True)]
        moved = 0.9 * moved - quality_classifier.RATE * lean
        w, bias = [a + b for a, b in zip(w, speed, strict=True)], bias + moved
    got = quality_classifier.fit_scorer(features, weights, target)
    assert np.allclose(got[:30], w, atol=1e-6) and abs(got[-1] - bias) < 1e-6 and not got[30:-1].any()


# --- registration


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
