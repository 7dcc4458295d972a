"""Incremental runs as Structured Streaming: new files are taken once, and results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skylattice.operators.matchgraph import MIN_MATCHES, canonical


def run_available(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand all files that were not seen yet to ``work`` in batches, then stop.  Restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_new_status(history: str, min_matches: int = MIN_MATCHES) -> Callable[[DataFrame, int], None]:
    """A batch function that verifies pairs not in the history table yet and appends them there."""

    def work(batch: DataFrame, _: int) -> None:
        new = canonical(batch).groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("inliers"))
        try:
            tried = batch.sparkSession.read.parquet(history).select("image_a", "image_b")
            new = new.join(tried, ["image_a", "image_b"], "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.withColumn("verified", (F.col("inliers") >= min_matches).cast("int")).write.mode("append").parquet(history)

    return work


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n of tumbling windows with a watermark; times without a zone are taken as UTC."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = stamped.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "n")
