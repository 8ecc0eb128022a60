"""Lexicons as one-column DataFrames and the probes against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(docs: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """``keys`` and one lower-cased word per row."""
    return docs.select(*keys, F.explode(T.words(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("word"))


def from_corpus(docs: DataFrame, min_freq: int = 2, *, weight: str | None = None) -> DataFrame:
    """Words found so often; ``weight``: a column of how often a text stands."""
    return tokens(docs, *([weight] if weight else [])).groupBy("word").agg(T.weighted(weight).alias("n")).filter(F.col("n") >= min_freq)


def from_hunspell(lines: DataFrame) -> DataFrame:
    """Words of a dictionary file (column ``value``): no blank, digit or # lines, text before the slash."""
    v = T.strip(F.col("value"))
    return lines.filter(v.rlike(r"^[^#\p{Nd}]")).select(F.lower(T.normalize(F.split(v, "/")[0])).alias("word")).filter("word <> ''").distinct()


def from_columns(table: DataFrame) -> DataFrame:
    """Distinct words of all string and string-array columns of a table, such as a verb table."""
    kinds = dict(table.dtypes)
    parts = [F.col(c) for c, k in kinds.items() if k == "string"] + [F.array_join(F.col(c), "\n") for c, k in kinds.items() if k == "array<string>"]
    joined = table.select(T.normalize(F.concat_ws("\n", *parts)).alias("text"))
    return tokens(joined).distinct()


def union(*lexicons: DataFrame, corpus: DataFrame | None = None, enough: int = 5_000) -> DataFrame:
    """Distinct words; the corpus lexicon joins only where the others hold fewer than ``enough``."""
    out = lexicons[0].select("word")
    for other in lexicons[1:]:
        out = out.union(other.select("word"))
    out = out.distinct()
    if corpus is not None and out.limit(enough).count() < enough:
        out = out.union(corpus.select("word")).distinct()
    return out


def oov_rates(docs: DataFrame, lexicon: DataFrame, *keys: str) -> DataFrame:
    """keys, n_tokens, n_oov, oov: share of words outside the lexicon, 1 without words.

    Words are counted per key before the probe, so a frequent word crosses the join once per key.
    """
    counted = tokens(docs, *keys).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    hit = counted.join(lexicon.select("word", F.lit(1).alias("known")), "word", "left")
    rates = hit.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_oov"))
    base = docs.select(*keys).distinct()
    on = None
    for k in keys:
        test = base[k].eqNullSafe(rates[k])
        on = test if on is None else on & test
    out = base.join(rates, on, "left").select(*(base[k] for k in keys), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_oov", F.lit(0)).alias("n_oov"))
    return out.withColumn("oov", F.when(F.col("n_tokens") > 0, F.col("n_oov") / F.col("n_tokens")).otherwise(1.0))


def missing_words(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of the documents that the lexicon lacks, with counts."""
    counted = tokens(docs).groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(lexicon.select("word"), "word", "left_anti")


def coverage(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row: types, known_types, tokens, known_tokens and both shares."""
    counted = tokens(texts).groupBy("word").agg(F.count("*").alias("n")).join(lexicon.select("word", F.lit(1).alias("known")), "word", "left")
    known = F.col("known").isNotNull()
    out = counted.agg(F.count("*").alias("types"), F.count_if(known).alias("known_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known_tokens"))
    return out.withColumn("type_coverage", F.coalesce(F.try_divide("known_types", "types"), F.lit(0.0))).withColumn("token_coverage", F.coalesce(F.try_divide("known_tokens", "tokens"), F.lit(0.0)))
