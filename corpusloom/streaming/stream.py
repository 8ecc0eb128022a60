"""The row-local part of the corpus build on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profile import DEFAULT, LanguageProfile
from ..operators.quality import clean_documents


def read_document_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(docs: DataFrame, profile: LanguageProfile = DEFAULT) -> DataFrame:
    """Normalised texts with their verdicts, as documents arrive."""
    return clean_documents(docs, profile)


def distinct_stream(docs: DataFrame, *, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First document of each canonical key; with an event time, keys are forgotten after ``delay``."""
    keyed = docs.withColumn("key", T.exact_hash(F.coalesce("text", F.lit(""))))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


def event_counts(events: DataFrame, *, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Windowed counts and sums of an event stream with late data dropped after ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
