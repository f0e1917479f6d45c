"""Feedback and corrections as streams. The reference service is synchronous; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trazo.functions import text as X
from trazo.sources.history import HistoryStore


#: How late a request may arrive and still count.
LATE = "90 days"


def feedback_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feedback requests as they arrive in a folder of parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, key: str = "fb_req_id", event_time: str = "sent_at", late: str = LATE) -> DataFrame:
    """Requests delivered twice pass once; state is kept as long as a request may be late."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def save_stream(stream: DataFrame, store: HistoryStore, checkpoint: str):
    """Starts the query that appends accepted feedback (user_id, fb_req_id, original, corrected, accepted) to the store."""

    def save(batch: DataFrame, batch_id: int) -> None:
        store.save_feedback(batch.select("user_id", F.col("fb_req_id").alias("seq"), "original", "corrected", X.truthy(F.col("accepted")).alias("accepted")))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_acceptance(stream: DataFrame, late: str = LATE) -> DataFrame:
    """(hour, n, n_accepted) by hour of sending, rows later than the watermark left out."""
    rows = stream.withColumn("sent_at", F.col("sent_at").cast("timestamp")).withWatermark("sent_at", late).groupBy(F.window("sent_at", "1 hour").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum(X.truthy(F.col("accepted")).cast("int")).alias("n_accepted")).select(F.col("w.start").alias("hour"), "n", "n_accepted")
