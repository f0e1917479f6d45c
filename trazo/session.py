"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where none is set, as in tests on one machine, a temporary folder is made and set;
    it goes with the process. What is written into a folder that was set is the owner's to
    keep or to clear, by spark.cleaner.referenceTracking.cleanCheckpoints for instance.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            own = tempfile.mkdtemp(prefix="trazo-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


#: Bytes of input that keep a core busy.
CORE_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, if its input is so small that some would stay idle; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * CORE_BYTES else df


def durable(df: DataFrame) -> DataFrame:
    """The frame, computed once and read from files that every executor can reach."""
    folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds the rows' numbers, from 1, in the order they come in; no task sees more than its own partition.

    The only thing brought together is a count for each partition.
    """
    rows = durable(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_part").withColumn(out, nth).drop("_at", "_part", "_before")
