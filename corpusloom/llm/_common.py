"""Shared plumbing of the training-data operators: durable scratch tables and null-safe keys.

Lineage is cut by writing Parquet tables below the folder named in ``spark.checkpoint.dir``;
every executor reads them again, so losing an executor loses no intermediate result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session for shared intermediate files; a temporary one where unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpusloom-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named intermediate tables of one operator run in the shared folder.

    ``table`` writes and rereads a DataFrame, ``drop`` frees one early; whatever is left goes
    when the driver's Python ends (the lazily evaluated result may still read it until then).
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete_path(self.spark, self.root)
            except Exception:  # the JVM may already be gone at interpreter exit
                pass


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` cast to ``kind``, or a typed null where the table has no such column."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
