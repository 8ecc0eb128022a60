"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. LABELLERS vote good, bad or abstain on each document.
2. Expectation-maximisation over the counted vote patterns (at most 3**10) estimates the class prior
   and each labeller's accuracy per class; no hand labels are read.
3. The posteriors of a bounded sample (``SAMPLE_ROWS`` documents of smallest hash, each once) train
   a logistic scorer on hashed word-shape features by full-batch gradient steps.
4. Every document is scored by the linear model; ``kept`` if its score reaches ``CUT``.

Null text has no words, every labeller that can vote calls it bad, and it is not kept. Each input row gives
one output row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACE, find_words, hash_spans, mix64, text_slices
from ._common import Scratch, column

LABELLERS = ("length", "symbols", "repeated_next", "variety", "upper", "word_length", "marks", "windows", "letters", "tails")
BINS = 1 << 14
#: Bound on the documents that fit the scorer.
SAMPLE_ROWS = 20_000
STEPS, RATE, DECAY = 150, 4.0, 1e-4
CUT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Byte classes of a word's shape: letters, capitals and digits fold, other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _vote(value: np.ndarray, good: np.ndarray | bool, bad: np.ndarray | bool) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, 2)).astype(np.int64) + 0 * value.astype(np.int64)


def votes_and_features(data: np.ndarray, offsets: np.ndarray, with_features: bool = True) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Vote pattern of each row in base 3 (0 bad, 1 good, 2 abstain), and its feature bins and weights if asked for."""
    starts, ends, first = find_words(data, offsets)
    rows = len(offsets) - 1
    n = np.diff(first)
    owner = np.repeat(np.arange(rows), n)
    hashes = hash_spans(data, starts, ends)
    some = np.maximum(n, 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = np.maximum(per_row(~SPACE[data]), 1)
    letters = np.maximum(per_row(_LETTER[data]), 1)
    symbols, upper = per_row(_SYMBOL[data]) / chars, per_row(_UPPER[data]) / letters
    mean = chars / some
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.bincount(owner, next_same, rows) / some
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marks = np.bincount(owner, np.isin(last, np.frombuffer(b"!?", np.uint8)), rows) / some
    tails = np.bincount(owner, _SYMBOL[last], rows) / some
    variety, windows = np.ones(rows), np.zeros(rows)
    for r in range(rows):
        own = hashes[first[r] : first[r + 1]]
        if len(own):
            variety[r] = len(np.unique(own)) / len(own)
        if len(own) > 16:
            w = mix64(own[:-3] * np.uint64(3) + own[1:-2] * np.uint64(5) + own[2:-1] * np.uint64(7) + own[3:] * np.uint64(11))
            windows[r] = 1 - len(np.unique(w)) / len(w)
    votes = [
        _vote(n, n >= 40, n < 3),
        _vote(n, (symbols < 0.02) & (n > 0), symbols > 0.05),
        _vote(n, (repeated < 0.08) & (n > 0), repeated > 0.2),
        _vote(n, (variety > 0.35) & (n >= 20), (variety < 0.15) & (n >= 20)),
        _vote(n, (upper < 0.15) & (n > 0), upper > 0.3),
        _vote(n, (mean >= 3) & (mean <= 9) & (n > 0), (mean < 2) | (mean > 14)),
        _vote(n, (marks < 0.1) & (n > 0), marks > 0.3),
        _vote(n, (windows < 0.05) & (n >= 20), windows > 0.3),
        _vote(n, letters / chars > 0.93, letters / chars < 0.85),
        _vote(n, (tails < 0.02) & (n > 0), tails > 0.08),
    ]
    pattern = sum(v * 3**k for k, v in enumerate(votes))
    if not with_features:
        return pattern, [], []
    # Features: shape of each word with runs folded, whether it repeats the one before, and coarse document statistics.
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    keep |= edge[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))
    shapes = hash_spans(shape[keep], at[starts], at[ends], lower=False) if len(starts) else np.zeros(0, np.uint64)
    bins = (mix64(shapes + next_same.astype(np.uint64)) % np.uint64(BINS)).astype(np.int32)
    features, weights = [], []
    coarse = np.stack([np.minimum(n, 200) // 20, (variety * 10).astype(int), (windows * 10).astype(int), (upper * 10).astype(int), (symbols * 20).astype(int), (repeated * 10).astype(int)])
    for r in range(rows):
        ids, count = np.unique(bins[first[r] : first[r + 1]], return_counts=True)
        extra = (mix64(coarse[:, r].astype(np.uint64) * np.uint64(97) + np.arange(1, 7, dtype=np.uint64) * np.uint64(1 << 33)) % np.uint64(BINS)).astype(np.int32)
        features.append(np.concatenate((ids, extra)))
        weights.append(np.concatenate((np.sqrt(count / max(1, n[r])), np.full(6, 0.5))).astype(np.float32))
    return pattern, features, weights


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """EM over vote patterns: posterior of 'good' for each pattern, and the fitted prior and accuracies.

    It starts from each pattern's majority vote, which also fixes which class is called good.
    """
    k = len(LABELLERS)
    votes = np.stack([patterns // 3**j % 3 for j in range(k)], axis=1)
    good, bad = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    post = (good + 0.5) / (good + bad + 1) if len(votes) else np.zeros(0)
    post = np.where(bad >= 1, post * 0.5, post)
    fitted = {}
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        prior = (w1.sum() + 1) / (counts.sum() + 2)
        table = np.stack([[[(w[votes[:, j] == v].sum() + 1) / (w.sum() + 3) for v in range(3)] for j in range(k)] for w in (w0, w1)])
        log = np.log(table)
        one = np.log(prior) + log[1, np.arange(k), votes].sum(axis=1)
        zero = np.log(1 - prior) + log[0, np.arange(k), votes].sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(zero - one, -500, 500)))
        fitted = {"prior": float(prior), "accuracy": {name: (float(table[0, j, 0]), float(table[1, j, 1])) for j, name in enumerate(LABELLERS)}}
        if len(new) and np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, fitted


def fit_scorer(features: list[np.ndarray], weights: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Logistic weights on hashed bins (last entry: bias), by full-batch gradient steps with momentum."""
    w = np.zeros(BINS + 1)
    if not len(target):
        return w
    sizes = np.array([len(f) for f in features])
    row, col, val = np.repeat(np.arange(len(features)), sizes), np.concatenate(features), np.concatenate(weights)
    balance = np.where(target >= 0.5, 0.5 / max(1e-9, (target >= 0.5).mean()), 0.5 / max(1e-9, (target < 0.5).mean()))
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        z = np.bincount(row, w[col] * val, len(target)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * balance / len(target)
        grad = np.append(np.bincount(col, error[row] * val, BINS), error.sum()) + DECAY * w
        speed = 0.9 * speed - RATE * grad
        w = w + speed
    return w


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, hash) -> hash and vote pattern; features are made where they are used."""
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(0)):
            pattern = votes_and_features(data, offsets, False)[0]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array(pattern, pa.int32())], ["hash", "pattern"])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1)):
            pattern, features, weights = votes_and_features(data, offsets)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), *(pa.array(c, k) for c, k in zip((pattern, features, weights), kinds, strict=True))], ["doc_id", "hash", "pattern", "bins", "weights"])


def _score(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1)):
            pattern, features, weights = votes_and_features(data, offsets)
            z = np.array([float(w[f] @ x) + w[-1] for f, x in zip(features, weights, strict=True)])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            score = np.where(np.diff(find_words(data, offsets)[2]) > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(pattern, pa.int32()), pa.array(score)], ["doc_id", "pattern", "score"])


def score_documents(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, score, weak_label (posterior of its votes), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "classifier")
    source = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"))
    keyed = source.withColumn("hash", F.xxhash64("text", F.lit(17)))
    schema = "doc_id long, hash long, pattern int, bins array<int>, weights array<float>"
    voted = scratch.table(keyed.select("text", "hash").mapInArrow(_votes, "hash long, pattern int"), "votes")
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3**10 rows
    patterns, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], float)
    posterior, _ = fit_labellers(patterns, n)
    weak = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    # The sample: the distinct texts of smallest hash, at most sample_rows.
    sample = scratch.table(voted.select("hash").distinct().orderBy("hash").limit(sample_rows), "sample")
    chosen = keyed.join(F.broadcast(sample), "hash", "left_semi").select("doc_id", "text", "hash")
    rows = scratch.table(chosen.mapInArrow(_patterns, schema).dropDuplicates(["hash"]).orderBy("hash"), "train").toArrow()
    w = fit_scorer(
        [np.asarray(x, np.int32) for x in rows.column("bins").to_numpy()], [np.asarray(x, np.float32) for x in rows.column("weights").to_numpy()], np.array([weak[p] for p in rows.column("pattern").to_pylist()])
    )
    shared = spark.sparkContext.broadcast(w)
    table = spark.createDataFrame([(int(p), float(v)) for p, v in weak.items()], "pattern int, weak_label double")
    out = source.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, pattern int, score double").join(F.broadcast(table), "pattern", "left")
    return out.select("doc_id", F.round("score", 9).alias("score"), F.round("weak_label", 9).alias("weak_label"), (F.col("score") >= CUT).alias("kept"))
