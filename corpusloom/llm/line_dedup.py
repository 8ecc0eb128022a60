"""Line deduplication by distinct-site spread.

All on the JVM. A line (stripped of outer white space, with at least one character left) is
boilerplate if it stands on ``MIN_SITES`` or more distinct sites. HyperLogLog sketches of the sites
are merged per line hash; an estimate farther than ``MARGIN`` standard errors (one site at least)
from the threshold decides alone, the lines nearer get an exact distinct count. Of a boilerplate
line the first occurrence (smallest doc_id, then earliest line) stays and every other one goes, so
text that only copies share is kept once.

A null site counts as no site, a null text has no lines. Null doc_ids sort first among
occurrences; repeated rows of one doc_id and text are treated alike, a first occurrence in them
stays in each. Blank lines are never boilerplate. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column

MIN_SITES = 10
LG_K = 12
MARGIN = 4
#: Tasks over which the rows of one line are dealt.
SALTS = 8
_STRIP = "trim(both ' \\t\\n\\u000B\\u000C\\r' from %s)"


def _key(df: DataFrame) -> dict[str, Column]:
    return {"__id": column(df, "doc_id", "bigint"), "__h": F.xxhash64(column(df, "text", "string"))}


def _lines(docs: DataFrame, site_col: str) -> DataFrame:
    """A row per non-blank line: row key, position, site, 64-bit hash and length of the stripped line."""
    text = column(docs, "text", "string")
    df = docs.select(*(c.alias(k) for k, c in _key(docs).items()), column(docs, site_col, "string").alias("site"), text.alias("t"))
    line = _STRIP % "x"
    df = df.select("__id", "__h", "site", F.posexplode(F.expr(f"transform(split(t, '\\n'), x -> named_struct('h', xxhash64({line}), 'n', length({line})))")).alias("pos", "l"))
    return df.select("__id", "__h", "site", "pos", F.col("l.h").alias("h"), F.col("l.n").alias("n")).filter("n > 0")


def _spread_out(keys: DataFrame) -> DataFrame:
    """``keys`` once for every salt: a line that a third of all rows hold meets ``SALTS`` tasks, not one.

    A key stands for at least as many lines as it has sites, so the copies stay below the lines they meet.
    """
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate_lines(lines: DataFrame, scratch: Scratch, min_sites: int) -> DataFrame:
    """(h, n) of the lines on at least ``min_sites`` sites."""
    spread = lines.filter("site is not null").groupBy("h", "n").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = spread.select("h", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, MARGIN * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = scratch.table(spread.filter(F.col("sites") >= min_sites - margin), "spread")
    near = _spread_out(spread.filter(F.col("sites") <= min_sites + margin).select("h", "n"))
    exact = lines.join(near, ["h", "n", "salt"], "left_semi").filter("site is not null").select("h", "n", "site").distinct().groupBy("h", "n").agg(F.count("*").alias("sites"))
    sure = spread.filter(F.col("sites") > min_sites + margin).select("h", "n")
    return scratch.table(sure.union(exact.filter(F.col("sites") >= min_sites).select("h", "n")), "boilerplate")


def _marked(docs: DataFrame, min_sites: int, site_col: str) -> DataFrame:
    """``docs`` plus __bad: positions of the lines to remove (null if none)."""
    scratch = Scratch(docs.sparkSession, "lines")
    salt = F.pmod(F.xxhash64("__id", "pos"), F.lit(SALTS)).cast("int")
    lines = scratch.table(_lines(docs, site_col).withColumn("salt", salt), "lines")
    bad = boilerplate_lines(lines, scratch, min_sites)
    held = scratch.table(lines.join(_spread_out(bad), ["h", "n", "salt"], "left_semi").drop("site"), "held")
    scratch.drop("lines")
    first = held.groupBy("h", "n").agg(F.min(F.struct("__id", "__h", "pos")).alias("first"))
    gone = held.join(_spread_out(first), ["h", "n", "salt"]).filter(~F.struct("__id", "__h", "pos").eqNullSafe(F.col("first")))
    gone = gone.groupBy("__id", "__h").agg(F.collect_set("pos").alias("__bad")).withColumnsRenamed({"__id": "__i", "__h": "__g"})
    gone = scratch.table(gone, "gone")
    keyed = docs.withColumns(_key(docs))
    # A merge join at every size: the removals grow with the documents, and texts move once.
    return keyed.join(gone.hint("merge"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")), "left").drop("__id", "__h", "__i", "__g")


_KEPT = "if(__bad is null, %s, array_join(filter(split(%s, '\\n'), (x, i) -> not array_contains(__bad, i)), '\\n'))"


def line_report(docs: DataFrame, *, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_chars, kept_sha256 of the text left over."""
    slim = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, site_col, "string").alias("site"))
    out = _marked(slim, min_sites, "site").withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumn("left_over", F.expr(_KEPT % ("text", "text")))
    lines = F.expr(f"cast(size(filter(split(text, '\\n'), x -> {_STRIP % 'x'} <> '')) as bigint)")
    return out.select("doc_id", lines.alias("n_lines"), F.expr("cast(coalesce(size(__bad), 0) as bigint)").alias("n_removed"), F.length("left_over").cast("bigint").alias("kept_chars"), F.sha2("left_over", 256).alias("kept_sha256"))


def remove_boilerplate(docs: DataFrame, *, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """The documents without boilerplate lines, columns as given; those left without a word go."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    out = _marked(docs, min_sites, site_col).withColumn("text", F.expr(_KEPT % ("text", "text")))
    out = out.filter(F.col("__bad").isNull() | F.expr(f"{_STRIP % 'text'} <> ''"))
    if "n_chars" in docs.columns:
        names = [F.when(F.col("__bad").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return out.select(*names, "text").select(*(F.col(f"`{c}`") for c in docs.columns))
