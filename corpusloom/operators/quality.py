"""Document quality: an ordered ladder of rejections and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profile import DEFAULT, LanguageProfile


def metrics(text: Column, profile: LanguageProfile = DEFAULT) -> dict[str, Column]:
    """Counts the ladder needs, by column name."""
    return {
        "n_words": F.size(T.words(text)),
        "word_letters": F.length(F.array_join(T.words(text), "")),
        "n_length": F.length(text),
        "n_alpha": T.letter_count(text),
        "n_digit": F.regexp_count(text, F.lit(r"\p{Nd}")),
        "n_punct": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s\p{Z}]")),
        "n_special": F.regexp_count(text, F.lit(T.quick_class(profile.special))),
        "adhoc": T.adhoc_score(text, profile),
    }


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")


def with_reason(docs: DataFrame, profile: LanguageProfile = DEFAULT, *, text_col: str = "text", oov_col: str | None = None) -> DataFrame:
    """``docs`` plus the ladder's metrics and ``reject_reason`` (null: accepted).

    The first failing rung names the reason. Metrics are columns, so each is computed once.
    ``oov_col`` names a column with the document's out-of-lexicon rate, if a lexicon is at hand.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns(metrics(t, profile) | {"__lines": _lines(t)})
    length = F.greatest(F.col("n_length"), F.lit(1))
    mean = F.col("word_letters") / F.greatest(F.col("n_words"), F.lit(1))
    lines = F.col("__lines")
    distinct = F.size(F.array_distinct(lines))
    rungs = [
        (T.is_blank(F.col(text_col)), "empty"),
        (F.col("n_words") < profile.min_words, "too_short"),
        (F.col("n_words") > profile.max_words, "too_long"),
        (mean < profile.min_mean_word, "words_too_short"),
        (mean > profile.max_mean_word, "words_too_long"),
        (F.col("n_alpha") / length < profile.min_alpha, "low_alpha"),
        (F.col("n_digit") / length > profile.max_digits, "digit_heavy"),
        (F.col("n_punct") / length > profile.max_punctuation, "punct_heavy"),
        (t.rlike(rf"(.)\1{{{profile.char_run - 1},}}"), "char_run"),
        ((F.size(lines) > 4) & (1 - distinct / F.greatest(F.size(lines), F.lit(1)) > profile.max_repeated_lines), "repeated_lines"),
        (F.coalesce(F.try_divide(F.col("n_special").cast("double"), F.col("n_alpha")), F.lit(0.0)) < profile.min_special, f"not_{_LANGUAGE[profile.code]}_charset"),
        (F.col("adhoc") > profile.max_adhoc, "adhoc_orthography"),
    ]
    if oov_col:
        rungs.append((F.col(oov_col) > profile.max_oov, "high_oov"))
    return df.withColumn("reject_reason", F.coalesce(*(F.when(test, F.lit(name)) for test, name in rungs))).drop("__lines")


def with_lexicon_reason(judged: DataFrame, rates: DataFrame, profile: LanguageProfile = DEFAULT) -> DataFrame:
    """doc_id, reject_reason: the ladder's verdict and, where it accepts, the last rung by ``rates`` (doc_id, oov).

    The same as ``with_reason`` with ``oov_col``, but no text meets the rates.
    """
    df = judged.select("doc_id", "reject_reason").join(rates.select("doc_id", "oov"), "doc_id")
    return df.select("doc_id", F.coalesce("reject_reason", F.when(F.col("oov") > profile.max_oov, "high_oov")).alias("reject_reason"))


#: Language names in the reason of the character-set rung.
_LANGUAGE = {"kab": "kabyle", "en": "target"}


def with_language_reason(df: DataFrame, profile: LanguageProfile = DEFAULT, *, text_col: str = "text", label_col: str | None = None, confidence_col: str | None = None, min_confidence: float = 0.6) -> DataFrame:
    """Add the language verdict to rows the ladder accepts.

    ``label_col``/``confidence_col`` hold a model's output; without them the model-free label is used
    and confidence is not judged.
    """
    label = F.col(label_col) if label_col else T.language_label(F.coalesce(F.col(text_col), F.lit("")), profile)
    verdict = F.when(~label.startswith(profile.code), F.concat(F.lit("lang_"), label))
    if confidence_col:
        verdict = verdict.when(F.col(confidence_col) < min_confidence, F.lit("lang_low_conf"))
    return df.withColumn("reject_reason", F.coalesce("reject_reason", verdict))


def clean_documents(docs: DataFrame, profile: LanguageProfile = DEFAULT, *, dehyphenate: bool = True) -> DataFrame:
    """Normalised text with its verdict; rejected rows stay, with their reason."""
    return with_reason(docs.withColumn("text", T.normalize(F.col("text"), profile, dehyphenate=dehyphenate)), profile)


def report_by_source(judged: DataFrame) -> DataFrame:
    """source, seen, kept, kept_words, top_reason. Ties of reasons go to the alphabetically first.

    One pass over the judged rows: all is told by counts per source and reason.
    """
    by = judged.groupBy("source", "reject_reason").agg(F.count("*").alias("n"), F.sum(F.col("n_words").cast("bigint")).alias("w"))
    kept = F.col("reject_reason").isNull()
    told = [F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).alias(name) for c, name in (("n", "kept"), ("w", "kept_words"))]
    top = F.min(F.when(~kept, F.struct((-F.col("n")).alias("n"), F.col("reject_reason").alias("r"))))
    return by.groupBy("source").agg(F.sum("n").alias("seen"), *told, top["r"].alias("top_reason"))


def reason_counts(judged: DataFrame) -> DataFrame:
    """One row with the map reason -> count, and seen = kept + rejected."""
    by = judged.groupBy("reject_reason").agg(F.count("*").alias("n"))
    pairs = F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.struct("reject_reason", "n")))
    return by.agg(F.sum("n").alias("seen"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.map_from_entries(F.array_sort(pairs)).alias("rejected"))


def top_reasons(judged: DataFrame, k: int = 5) -> DataFrame:
    return judged.filter("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reject_reason").limit(k)


def totals_rollup(judged: DataFrame) -> DataFrame:
    """Per-source document and word counts with a TOTAL row."""
    out = judged.rollup("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_words").cast("bigint")).alias("words"), F.grouping("source").alias("g"))
    return out.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("source")).alias("source"), "documents", "words")


def strip_running_heads(docs: DataFrame, *, min_repeats: int = 5, max_length: int = 59) -> DataFrame:
    """doc_id, text without page-number lines and short lines that recur in the document.

    Works inside each row: a document's lines never leave it.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    df = docs.withColumn("__l", lines).withColumn("__s", F.transform("__l", T.strip)).withColumn("__o", F.array_sort("__s"))
    # In sorted order a line that stands ``min_repeats`` times equals the one so many places on.
    often = F.filter("__o", lambda x, i: F.coalesce(x == F.get("__o", i + (min_repeats - 1)), F.lit(False)) & F.length(x).between(1, max_length))
    df = df.withColumn("__heads", F.array_distinct(often))
    kept = F.filter("__l", lambda x: ~x.rlike(r"^\s*\p{Nd}{1,4}\s*$") & ~F.array_contains(F.col("__heads"), T.strip(x)))
    return df.withColumn("text", F.array_join(kept, "\n")).drop("__l", "__s", "__o", "__heads")


def residual_audit(docs: DataFrame, profile: LanguageProfile = DEFAULT) -> DataFrame:
    """(character, n) of the characters outside the profile's set."""
    chars = docs.select(F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), T.quick_class(profile.canonical), ""), "")).alias("character"))
    return chars.filter("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def normalization_report(docs: DataFrame, profile: LanguageProfile = DEFAULT) -> DataFrame:
    """One row: characters in and out, folded characters of the raw text, residual ones after."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    from ..functions.profile import LOOK_ALIKES

    folded = F.regexp_count(raw, F.lit(T.quick_class("".join(LOOK_ALIKES.values()))))
    df = docs.select(raw.alias("raw"), folded.alias("f"), T.normalize(raw, profile).alias("out"))
    left = F.regexp_count("out", F.lit(T.quick_class(profile.canonical, negate=True)))
    return df.agg(F.sum(F.length("raw")).alias("chars_in"), F.sum(F.length("out")).alias("chars_out"), F.sum("f").alias("folded"), F.sum(left).alias("residual"), (F.sum(left) == 0).alias("is_clean"))
