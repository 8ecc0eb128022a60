"""Aggregates over model output: the scores, losses and generations are input tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexicon import oov_rates
from .tokens import fertility


def perplexity(rows: DataFrame, *groups: str) -> DataFrame:
    """groups, perplexity: exp of the token-weighted mean loss of rows (nll, n_tokens); rows with no token to
    predict are left out, and a group without any has infinity."""
    n = F.col("n_tokens") - 1
    used = n >= 1
    loss = F.sum(F.when(used, F.col("nll") * n)) / F.nullif(F.sum(F.when(used, n)), F.lit(0))
    return rows.groupBy(*groups).agg(F.coalesce(F.exp(loss), F.lit(float("inf"))).alias("perplexity"))


def perplexity_spread(by_domain: DataFrame) -> DataFrame:
    """One row: spread (largest over smallest) and whether it is balanced (under 3)."""
    out = by_domain.agg(F.try_divide(F.max("perplexity"), F.min("perplexity")).alias("spread"))
    return out.withColumn("balanced", F.col("spread") < 3)


def language_purity(generations: DataFrame, code: str = "kab") -> DataFrame:
    """Share of rows whose ``label`` starts with ``code``; 0 without rows."""
    return generations.agg(F.coalesce(F.avg(F.col("label").startswith(code).cast("double")), F.lit(0.0)).alias("purity"))


def accuracy(rows: DataFrame) -> DataFrame:
    """Share of rows whose first largest of ``scores`` stands at ``answer`` (from 0)."""
    pick = F.array_position("scores", F.array_max("scores")) - 1
    return rows.agg(F.coalesce(F.avg((pick == F.col("answer")).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def forgetting(base: Column, model: Column) -> Column:
    """Drop against the base model and whether it passes (under 0.05)."""
    drop = base - model
    return F.struct(drop.alias("drop"), F.when(drop < 0.05, "ok").otherwise("forgetting").alias("verdict"))


def bits_per_character(loss: Column, tokens: Column, chars: Column) -> Column:
    return loss / F.log(F.lit(2.0)) * tokens / chars


def _split_words(c: Column) -> Column:
    """White-space tokens with one leading or trailing punctuation mark set apart."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(?<=[^\s\p{Z}])(\p{P})(?=[\s\p{Z}]|$)", " $1"), r"(?<=^|[\s\p{Z}])(\p{P})(?=[^\s\p{Z}])", "$1 ")
    return F.filter(F.split(spaced, r"[\s\p{Z}]+"), lambda x: x != "")


def _matched(batches: Iterator[pa.RecordBatch], char_order: int, word_order: int) -> Iterator[pa.RecordBatch]:
    """Batches (ch, cr, wh, wr) -> per batch and order o (characters first, then words) the matched n-grams m and those of each side, h and r."""
    for batch in batches:
        sums = np.zeros((char_order + word_order, 3), np.int64)
        rows = (row for low in range(0, len(batch), 256) for row in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True))
        for ch, cr, wh, wr in rows:
            for o in range(char_order + word_order):
                a, b, n = (ch, cr, o + 1) if o < char_order else (wh, wr, o + 1 - char_order)
                h, r = max(0, len(a) - n + 1), max(0, len(b) - n + 1)
                sums[o, 1:] += (h, r)
                if h and r:
                    x, y = (Counter(s[i : i + n] for i in range(k)) if o < char_order else Counter(tuple(s[i : i + n]) for i in range(k)) for s, k in ((a, h), (b, r)))
                    if len(y) < len(x):
                        x, y = y, x
                    sums[o, 0] += sum(min(c, y[g]) for g, c in x.items() if g in y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), *(pa.array(sums[:, k]) for k in range(3))], ["o", "m", "h", "r"])


def chrf(pairs: DataFrame, *, char_order: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """Corpus chrF++ of (id, hypothesis, reference): F-beta of matched n-grams per order, averaged, times 100.

    A pair's n-grams are matched where the pair is; a row per batch and order is shuffled. Orders without n-grams on either side are left out of the average.
    """
    sides = {"h": F.coalesce("hypothesis", F.lit("")), "r": F.coalesce("reference", F.lit(""))}
    chars = [F.regexp_replace(c, r"[\s\p{Z}]+", "").alias(f"c{s}") for s, c in sides.items()]
    df = pairs.select(*chars, *(_split_words(c).alias(f"w{s}") for s, c in sides.items()))
    counts = df.mapInArrow(lambda it: _matched(it, char_order, word_order), "o long, m long, h long, r long")
    by = counts.groupBy("o").agg(*(F.sum(c).alias(c) for c in "mhr")).filter("h > 0 and r > 0")
    p, r = F.col("m") / F.col("h"), F.col("m") / F.col("r")
    f = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    return by.agg(F.coalesce(100 * F.avg(f), F.lit(0.0)).alias("chrf"))


def mean_loss(rows: DataFrame, *groups: str) -> DataFrame:
    """Weighted mean of (loss, n) per group."""
    return rows.groupBy(*groups).agg((F.sum(F.col("loss") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("loss"))


def best_checkpoint(losses: DataFrame) -> DataFrame:
    """step, val_loss of the smallest validation loss; ties go to the earliest step."""
    return losses.agg(F.min(F.struct("val_loss", "step")).alias("b")).select("b.step", "b.val_loss")


def budget(n_params: Column, n_tokens: Column, *, tflops: float = 35.0, mfu: float = 1.0, session_hours: int = 11, week_hours: int = 30) -> Column:
    """Hours for 6 * parameters * tokens operations, sessions they take, and their share of a week's quota."""
    hours = 6 * n_params * n_tokens / (tflops * 1e12 * mfu) / 3600
    return F.struct(hours.alias("hours"), F.ceil(hours / session_hours).alias("sessions"), (hours / week_hours).alias("week_share"))


def learning_rate(step: Column, *, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``floor``."""
    p = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / warmup).otherwise(F.lit(floor) + 0.5 * (peak - floor) * (1 + F.cos(F.pi() * p)))


def corpus_token_estimate(words: Column, *, before: float = 2.75, after: float = 1.9) -> Column:
    """Expected tokens of so many words before and after extending the vocabulary."""
    return F.struct((words * before).alias("tokens_before"), (words * after).alias("tokens_after"))


def with_label(generations: DataFrame) -> DataFrame:
    return generations.withColumn("label", T.language_label(F.coalesce("text", F.lit(""))))


def evaluate(losses: DataFrame, generations: DataFrame, human: DataFrame, words: DataFrame, choices: DataFrame, lexicon: DataFrame, *, special: str, base_choices: DataFrame | None = None) -> DataFrame:
    """One row of all scores of a model, from tables of its output.

    ``losses``: domain, nll, n_tokens; ``generations`` and ``human``: text; ``words``: pos, word,
    n_tokens, n_unk of held-out text; ``choices``: scores, answer of the benchmark, ``base_choices``
    those of the base model, for the verdict on forgetting. ``oov_human`` is the floor of ``oov``.
    """
    domains = perplexity(losses, "domain")
    whole = lambda df: oov_rates(df.select("text", F.lit(0).alias("k")), lexicon, "k").select("oov")
    parts = [
        domains.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "perplexity")))).alias("perplexity")),
        perplexity_spread(domains),
        fertility(words, special=special).select("tokens_per_word", "unk_rate"),
        language_purity(with_label(generations)),
        whole(generations),
        whole(human).withColumnRenamed("oov", "oov_human"),
        accuracy(choices).select("accuracy"),
    ]
    if base_choices is not None:
        parts.append(accuracy(base_choices).select(F.col("accuracy").alias("base_accuracy")))
    out = reduce(lambda a, b: a.join(F.broadcast(b), how="left"), parts)  # one row each
    if base_choices is not None:
        out = out.withColumn("forgetting", forgetting(F.col("base_accuracy"), F.col("accuracy")))
    return out
