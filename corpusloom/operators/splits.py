"""Splits, samples and mixes. Order comes from md5 of (seed, id): the same in any engine and parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_int
from .ranking import with_rank

SEED = 1337


def hash_order(seed: int, *ids: Column) -> list[Column]:
    """Sort keys of a reproducible shuffle."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *(i.cast("string") for i in ids))), *ids]


def stratified_split(docs: DataFrame, *, val_frac: float = 0.01, test_frac: float = 0.01, min_eval: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, source, split. Each source gives max(min(min_eval, n // 10), int(n * frac)) documents
    to val and to test, or none where that would take all.

    A source's hashes fall in 65,536 cells; their sizes tell which cells hold the smallest hashes, and
    rows are ranked inside those cells only, so a source with a third of all rows is not one task.
    """
    key, order = hash_order(seed, F.col("doc_id"))
    keyed = docs.select("doc_id", "source", key.alias("__h")).withColumn("__cell", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    part = Window.partitionBy("source")
    cells = keyed.groupBy("source", "__cell").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(part))
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(part.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    floor = F.least(F.lit(min_eval), F.floor(F.col("n") / 10))
    cells = cells.withColumn("v", F.greatest(floor, F.floor(F.col("n") * val_frac))).withColumn("t", F.greatest(floor, F.floor(F.col("n") * test_frac)))
    cells = cells.filter((F.col("v") + F.col("t") < F.col("n")) & (F.col("before") < F.col("v") + F.col("t")))
    cells = cells.select(F.col("source").alias("__s"), F.col("__cell").alias("__c"), "before", "v", "t")
    df = keyed.join(cells, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c")), "left")
    df = df.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("source", "__cell").orderBy("__h", order)))
    split = F.when(F.col("k") <= F.col("v"), "val").when(F.col("k") <= F.col("v") + F.col("t"), "test").otherwise("train")
    return df.select("doc_id", "source", split.alias("split"))


def weighted_copies(docs: DataFrame, weights: DataFrame, *, seed: int = SEED) -> DataFrame:
    """``docs`` with each row int(w) times, once more with chance frac(w). ``weights``: source, weight; missing is 1.

    Rows of weight under one may vanish; ``copy`` numbers the copies.
    """
    df = docs.join(weights, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    extra = hash_int(F.lit(seed), F.col("doc_id")) / F.lit(4294967296.0) < F.col("weight") - F.floor("weight")
    df = df.withColumn("reps", (F.floor("weight") + extra.cast("int")).cast("int"))
    return df.filter("reps > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("reps")))).drop("reps")


def block_split(items: DataFrame, *, block: int, fraction: float, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """items plus ``split``: max(1, round(blocks * fraction)) hash-chosen blocks of consecutive ids are val."""
    df = items.withColumn("__block", F.floor(F.col(id_col) / block))
    ranked = with_rank(df.select("__block").distinct(), *hash_order(seed, F.col("__block")), name="__rank")
    wanted = ranked.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction))).alias("__wanted"))
    chosen = ranked.join(F.broadcast(wanted)).filter("__rank <= __wanted").select("__block", F.lit("val").alias("split"))  # one row
    return df.join(chosen, "__block", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("__block")


def sequential_split(items: DataFrame, fraction: float = 0.9, id_col: str = "doc_id") -> DataFrame:
    """The first ``fraction`` of the items in id order train, the rest validate.

    Ids are counted by range; only the range with the cut is ordered. Rows of one id stay together.
    """
    ranged = items.withColumn("__range", F.floor(F.col(id_col) / 4096))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("__range"))
    bound = items.agg(F.floor(F.count("*") * fraction).alias("n"))
    cut = sizes.withColumn("upto", upto).join(F.broadcast(bound)).filter("upto >= n and upto - c < n").select("__range", (F.col("n") - F.col("upto") + F.col("c")).alias("k"))  # one row each
    inside = ranged.join(F.broadcast(cut), "__range").withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(id_col)))
    last = inside.filter("__k = k").agg(F.max(id_col).alias("__last"))
    return items.join(F.broadcast(last)).withColumn("split", F.when(F.col(id_col) <= F.col("__last"), "train").otherwise("val")).drop("__last")  # one row


def first_per_group(docs: DataFrame, k: int, group: str = "source", order: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return docs.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def sample_per_group(docs: DataFrame, n: int, *, first: int = 500, seed: int = 0, group: str = "source") -> DataFrame:
    """n hash-chosen rows per group among its first ``first`` rows."""
    head = first_per_group(docs, first, group)
    w = Window.partitionBy(group).orderBy(*hash_order(seed, F.col("doc_id")))
    return head.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def prefix_by_chars(docs: DataFrame, max_chars: int = 400_000) -> DataFrame:
    """Documents in id order until their lengths reach ``max_chars``; the crossing one is included.

    Running sums per range of ids first, then over the ranges: no task orders the whole table.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    df = docs.withColumn("__range", F.floor(F.col("doc_id") / 4096)).withColumn("__len", size)
    inner = Window.partitionBy("__range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy("__range").agg(F.sum("__len").alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(outer), F.lit(0))).filter(F.col("__before") < max_chars).drop("s")
    df = df.join(before, "__range").withColumn("__in", F.coalesce(F.sum("__len").over(inner), F.lit(0)))
    return df.filter(F.col("__before") + F.col("__in") < max_chars).drop("__range", "__len", "__before", "__in")


def interleave(parts: dict[str, tuple[DataFrame, float]], total: int, *, seed: int = SEED) -> DataFrame:
    """About ``total`` rows in hash order with the given shares; short sources repeat until theirs is reached."""
    whole = sum(share for _, share in parts.values())
    out = None
    for name, (df, share) in parts.items():
        need = int(round(total * share / whole))
        have = df.count()
        if not have or not need:
            continue
        reps = -(-need // have)
        ranked = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("__o", F.md5(F.concat_ws("|", F.lit(str(seed)), "copy", "doc_id")))
        part = ranked.orderBy("copy", "__o").limit(need).withColumn("stream", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("__o").drop("__o")


def shuffled(df: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(*hash_order(seed, F.col(id_col)))
