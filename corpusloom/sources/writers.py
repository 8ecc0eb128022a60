"""Sinks: JSON-lines splits, weighted mixes, chat files, text and one-row reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(docs: DataFrame, splits: DataFrame, path: str) -> DataFrame:
    """``docs`` as JSON lines in one folder per split; returns split, n."""
    df = docs.join(splits.select("doc_id", "split"), "doc_id")
    df.write.mode("overwrite").partitionBy("split").json(path)
    return splits.groupBy("split").agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Rows as JSON lines; ``one_file`` only for reports of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_report(path: str, **parts: DataFrame) -> None:
    """One JSON object holding the rows of small report tables by name."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = row if out is None else out.join(F.broadcast(row))  # one row each
    write_json(out, path, one_file=True)


def write_chat(examples: DataFrame, path: str) -> None:
    """The ``messages`` arrays as JSON lines."""
    write_json(examples.select("messages"), path)


def write_texts(decoded: DataFrame, path: str) -> None:
    """Decoded texts, one folder per document."""
    decoded.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def report_table(report: DataFrame) -> DataFrame:
    """Per-source report, most words first."""
    return report.orderBy(F.desc("kept_words"), "source")
