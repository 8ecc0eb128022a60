"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

All on the JVM. The sketch of a group is a table of (metric, bucket, count): values below 64 have a
bucket each, larger ones share buckets of 1/32 relative width, so sketches merge by adding counts,
give the same quantiles in any order of merging, and hold under a thousand rows per group and
metric. The cut-off of a metric is q75 + FENCE * (q75 - q25) + its slack; groups of fewer than
``MIN_GROUP`` documents use their language's sketch, and small languages the merged sketch of all.
Documents above any cut-off, or failing the base rules, are rejected.

Null text has no words and fails the base rules. Null language or source is a group of its own.
Every input row gives one verdict; repeated rows get equal ones. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, column

#: Metric: (permille expression, slack in permille).
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 40),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 100),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 250),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", 4000),
}
FENCE = 3
MIN_GROUP = 50
WINDOW = 8
#: Array of hashes of twice as many words from array ``a`` of hashes of ``k`` words.
_DOUBLE = "if(size({a}) > {k}, zip_with(slice({a}, 1, size({a}) - {k}), slice({a}, {k} + 1, size({a}) - {k}), (x, y) -> xxhash64(x, y)), cast(array() as array<bigint>))"
_WS = "\\\\x20\\\\x09-\\\\x0D"


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Helper columns start with two underscores and are dropped again.
    """
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    df = docs.withColumn("__t", text).withColumn("__b", F.expr("trim(both ' \\t\\n\\u000B\\u000C\\r' from __t)"))
    df = df.withColumn("__a", F.expr(f"if(__b = '', cast(array() as array<string>), split(__b, '[{_WS}]+'))"))
    df = df.withColumn("__w", F.expr("transform(__a, x -> xxhash64(x))"))
    df = df.withColumn("__l", F.expr(f"filter(split(__t, '\n'), x -> x rlike '[^{_WS}]')"))
    # Windows of 2, 4 and 8 words by doubling; a text without a repeated 4-word window has no longer one.
    df = df.withColumn("__h2", F.expr(_DOUBLE.format(a="__w", k=1))).withColumn("__h4", F.expr(_DOUBLE.format(a="__h2", k=2)))
    df = df.withColumn("__h", F.expr(f"if(size(array_distinct(__h4)) < size(__h4), {_DOUBLE.format(a='__h4', k=4)}, cast(array() as array<bigint>))"))
    # Windows found twice or more; only texts that have any are sorted.
    df = df.withColumn("__s", F.expr("if(size(array_distinct(__h)) < size(__h), sort_array(transform(__h, (x, i) -> named_struct('x', x, 'i', i))), null)"))
    df = df.withColumn("__p", F.expr("if(__s is null, null, sort_array(transform(filter(transform(__s, (x, i) -> named_struct('i', x.i, 'd', coalesce(x.x = get(__s, i - 1).x, false) or coalesce(x.x = get(__s, i + 1).x, false))), x -> x.d), x -> x.i)))"))
    repeated = f"coalesce(aggregate(transform(__p, (x, i) -> coalesce(least({WINDOW}, get(__p, i + 1) - x), {WINDOW})), 0L, (a, x) -> a + x), 0L)"
    df = df.withColumns(
        {
            "n_words": F.expr("cast(size(__a) as bigint)"),
            "word_chars": F.expr("cast(length(array_join(__a, '')) as bigint)"),
            "n_symbols": F.expr("cast(regexp_count(__t, '[#*$%&|<>]') as bigint)"),
            "n_lines": F.expr("cast(size(__l) as bigint)"),
            "n_dup_lines": F.expr("cast(size(__l) - size(array_distinct(__l)) as bigint)"),
            "n_repeat_words": F.expr(repeated),
        }
    )
    df = df.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return df.drop("__t", "__b", "__a", "__w", "__l", "__h2", "__h4", "__h", "__s", "__p")


def _metric(name: str) -> Column:
    return F.expr(f"cast({METRICS[name][0]} as bigint)")


def sketches(counted: DataFrame) -> DataFrame:
    """Merged sketches: lang, source, metric, bucket, n over the documents that pass the base rules."""
    values = F.array(*(F.struct(F.lit(name).alias("metric"), _metric(name).alias("v")) for name in METRICS))
    rows = counted.filter("not base_failed").select(column(counted, "lang", "string").alias("lang"), column(counted, "source", "string").alias("source"), F.explode(values).alias("m"))
    bucket = F.expr("shiftleft(shiftright(m.v, greatest(0, length(bin(m.v)) - 6)), greatest(0, length(bin(m.v)) - 6))")
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and one cut-off column per metric, from the narrowest group that is large enough."""
    spec = {"own": ["lang", "source"], "lang": ["lang"], "all": []}
    cuts = {}
    for level, keys in spec.items():
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "metric")
        merged = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket"))).withColumn("total", F.sum("n").over(part))
        at = merged.groupBy(*keys, "metric").agg(
            F.max("total").alias("total"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q25"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q75"),
        )
        cut = F.col("q75") + FENCE * (F.col("q75") - F.col("q25"))
        cuts[level] = at.groupBy(*keys).agg(F.max("total").alias(f"{level}_n"), *(F.max(F.when(F.col("metric") == name, cut + slack)).alias(f"{level}_{name}") for name, (_, slack) in METRICS.items()))
    own = cuts["own"].withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    lang = cuts["lang"].withColumnRenamed("lang", "l_lang")
    out = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(cuts["all"]))  # one row
    pick = [
        F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{name}")).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{name}")).otherwise(F.col(f"all_{name}")).alias(f"cut_{name}")
        for name in METRICS
    ]
    return out.select("g_lang", "g_source", *pick)


def _judge(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` with ``kept``; groups without a cut-off hold only documents that fail the base rules."""
    lang, source = column(counted, "lang", "string"), column(counted, "source", "string")
    joined = counted.withColumns({"__g": lang, "__k": source}).join(cuts, F.col("__g").eqNullSafe(F.col("g_lang")) & F.col("__k").eqNullSafe(F.col("g_source")), "left")
    above = reduce(lambda a, b: a | b, (_metric(name) > F.col(f"cut_{name}") for name in METRICS))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(above, F.lit(False))).drop("__g", "__k", "g_lang", "g_source")


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, kept and the cut-offs used."""
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(*(column(docs, c, t).alias(c) for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("text", "string"))))
    counted = scratch.table(with_counts(slim).drop("text"), "counts")
    cuts = scratch.table(thresholds(sketches(counted)), "cuts")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judge(counted, cuts).select(*names, *(f"cut_{name}" for name in METRICS))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns as given, whatever their names.

    Rows are written once with their counts, so no filter reaches back through the count expressions
    and no text is counted or moved a second time.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    slim = docs.select(given, *(column(docs, c, "string").alias(c) for c in ("lang", "source", "text")))
    counted = scratch.table(with_counts(slim).drop("text"), "counts")
    cuts = scratch.table(thresholds(sketches(counted)), "cuts")
    return _judge(counted, cuts).filter("kept").select("row.*")
