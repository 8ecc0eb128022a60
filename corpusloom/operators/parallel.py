"""Parallel pairs and conversations: filters, reshaping and pair loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.profile import DEFAULT, LanguageProfile

MIN_TARGET, MAX_TARGET, MAX_RATIO, MAX_OVERLAP, MIN_SPECIAL = 3, 200, 2.5, 0.6, 0.01


def pair_reason(src: Column, tgt: Column, profile: LanguageProfile = DEFAULT, *, min_special: float = MIN_SPECIAL) -> Column:
    """First reason to reject a pair, or null. Word overlap counts lower-cased words over the target's
    distinct words as written."""
    s, t = F.coalesce(src, F.lit("")), F.coalesce(tgt, F.lit(""))
    sw, tw = T.words(s), T.words(t)
    longer, shorter = F.greatest(F.size(sw), F.size(tw)), F.least(F.size(sw), F.size(tw))
    shared = F.size(F.array_intersect(F.transform(sw, F.lower), F.transform(tw, F.lower)))
    return F.coalesce(
        F.when(T.is_blank(s) | T.is_blank(t), "empty_side"),
        F.when((F.size(tw) < MIN_TARGET) | (F.size(tw) > MAX_TARGET), "target_length"),
        F.when(longer / F.greatest(shorter, F.lit(1)) > MAX_RATIO, "length_mismatch"),
        F.when(shared / F.greatest(F.size(F.array_distinct(tw)), F.lit(1)) > MAX_OVERLAP, "untranslated"),
        F.when(T.special_rate(t, profile) < min_special, "target_not_kabyle"),
    )


def adjacent_turns(conversations: DataFrame, first: str = "user", second: str = "assistant") -> DataFrame:
    """conv_id, turn, src, tgt of each ``first`` turn answered right away by a ``second`` turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = conversations.withColumn("tgt", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return df.filter((F.col("role") == first) & (F.col("next_role") == second)).select("conv_id", "turn", F.col("text").alias("src"), "tgt")


def flatten_conversations(nested: DataFrame, profile: LanguageProfile = DEFAULT, *, min_special: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Turns of ``conversations array<struct<from, value>>`` that are not blank and in the language,
    and a one-row count of those dropped."""
    turns = nested.select(F.explode("conversations").alias("t")).select(F.col("t.from").alias("role"), F.col("t.value").alias("text"))
    good = ~T.is_blank(F.col("text")) & (T.special_rate(F.coalesce("text", F.lit("")), profile) >= min_special)
    return turns.filter(good), turns.agg(F.count_if(~good).alias("dropped"))


def turn_filter(turns: DataFrame, profile: LanguageProfile = DEFAULT, *, min_special: float = 0.01) -> DataFrame:
    """role, turns, blank, off_language, kept of a table with a row per turn."""
    blank = T.is_blank(F.col("text"))
    off = ~blank & (T.special_rate(F.coalesce("text", F.lit("")), profile) < min_special)
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(blank).alias("blank"), F.count_if(off).alias("off_language"), F.count_if(~blank & ~off).alias("kept"))


def pull_translation(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """text: the first present key of the ``translation`` struct or map; null and blank sides are dropped."""
    kind = rows.schema["translation"].dataType
    names = set(kind.names) if hasattr(kind, "names") else None
    picks = [F.col(f"translation.{k}") if names else F.try_element_at("translation", F.lit(k)) for k in keys if names is None or k in names]
    return rows.select(F.coalesce(*picks).alias("text")).filter(~T.is_blank(F.col("text")))


def load_pairs(sources: list[tuple[str, str, DataFrame]], *, cap: int, profile: LanguageProfile = DEFAULT) -> DataFrame:
    """source, src, tgt of verified pairs, at most ``cap`` a source in row order.

    ``sources``: (name, trust, table with an English and a target column). Noisy ones and those without
    both columns are skipped; only the target is normalised.
    """
    out = None
    for name, trust, df in sources:
        lower = {c.lower(): c for c in df.columns}
        other = next((lower[c] for c in ("en", "english", "eng", "source", "src") if c in lower), None)
        target = next((lower[c] for c in ("kab", "kabyle", "target", "tgt") if c in lower), None)
        if trust == "noisy" or not other or not target:
            continue
        order = lower.get("pair_id", other)
        part = df.select(F.lit(name).alias("source"), F.col(order).alias("__o"), F.col(other).alias("src"), T.normalize(F.col(target), profile).alias("tgt"))
        part = part.filter(pair_reason(F.col("src"), F.col("tgt"), profile).isNull()).orderBy("__o").limit(cap).drop("__o")
        out = part if out is None else out.union(part)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a length differs or a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = [F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) for x in (a, b)]
    return F.try_divide(dot, norm[0] * norm[1])


def round_trip_filter(rows: DataFrame, *, min_cosine: float = 0.75, max_oov: float = 0.5, oov_col: str | None = None) -> DataFrame:
    """rows (emb_a, emb_b and maybe an oov column) plus cosine and keep."""
    df = rows.withColumn("cosine", cosine(F.col("emb_a"), F.col("emb_b")))
    good = F.coalesce(F.col("cosine") >= min_cosine, F.lit(False))
    if oov_col:
        good = good & (F.coalesce(F.col(oov_col), F.lit(0.0)) <= max_oov)
    return df.withColumn("keep", good)
