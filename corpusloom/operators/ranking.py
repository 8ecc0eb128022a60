"""Global ranks without a global window, and the checkpoint folder they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder in ``spark.checkpoint.dir``; a temporary one serves a local master only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    context.setCheckpointDir(path)


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` plus its 1-based place in ``order``, from a range-partitioned sort.

    Rows are numbered inside their partition and the partitions' sizes summed up before it: only a
    row per partition meets in one task. The sorted rows are checkpointed, so both reads agree.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    within = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + within + 1).drop("__at", "__part", "__before")  # a row per partition
