"""Chat corpora: cleaned messages, their statistics and training streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .splits import block_split

COUNTERS = ("empty", "notices", "tags", "links", "emails", "phones", "repeats", "emptied")


def clean_messages(lines: DataFrame, *, line_col: str = "line") -> DataFrame:
    """``lines`` plus message (null: dropped) and the eight counters."""
    df = lines.withColumn("__c", T.clean_chat(F.col(line_col)))
    return df.select(*lines.columns, F.col("__c.message").alias("message"), *(F.col(f"__c.{k}").alias(k) for k in COUNTERS))


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("lines"), F.count("message").alias("kept"), *(F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in COUNTERS))


def chat_stream(cleaned: DataFrame, *, block: int = 200, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """doc_id, message, split: kept messages, split by blocks of consecutive ones."""
    kept = cleaned.filter("message is not null").select("doc_id", "message")
    return block_split(kept, block=block, fraction=fraction, seed=seed)


def characters_per_token(rows: DataFrame) -> DataFrame:
    """From (n_chars, n_tokens): chars, tokens, ratio."""
    out = rows.agg(F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens"))
    return out.withColumn("chars_per_token", F.try_divide("chars", "tokens"))
