"""Deliveries as a stream: incremental merge without repeated keys, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_stream(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose key is not yet in the table at target.

    A batch that is run again finds its own keys there and appends nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates([key])
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        old = spark.read.parquet(target).select(key) if there else None
        (first if old is None else first.join(old, key, "left_anti")).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivery_counts(stream: DataFrame, time: str = "ingested_at", late: str = "30 days", window: str = "1 day", by: str = "source") -> DataFrame:
    """Rows and seconds delivered by window and source; windows close once data may no longer be late."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("rows"), F.sum("duration").alias("seconds")).select(
        F.col("window.start").alias("day"), by, "rows", "seconds"
    )


def distinct_deliveries(stream: DataFrame, key: str = "id", time: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """The first delivery of each key within the time that data may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
