"""Incremental ingest: new line files of a folder, once each, into a partitioned table of typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schema


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, kind: str) -> StreamingQuery:
    """Reads what has come since the last run and stops; records go to target by community and month, each file once."""
    lines = spark.readStream.option("lineSep", "\n").text(source)
    rows = schema.parse(lines.select("value", F.col("_metadata.file_path").alias("path")), kind)
    rows = rows.withColumn("month", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM"))
    return rows.writeStream.format("parquet").partitionBy("month").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_by_window(records: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Records and authors (approximate) by community and time window, for a stream with a watermark or a table."""
    timed = records.withColumn("ts", F.timestamp_seconds("created_utc")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "subreddit").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("author").alias("authors"), F.sum("score").alias("score"))
