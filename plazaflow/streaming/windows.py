"""Windows over event streams: extensions beyond the agenda's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows; with `late`, events later than that are dropped and windows closed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap longer than `gap`."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, late: str) -> DataFrame:
    """Events by id, each once within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now to Parquet and stops; a second run goes on where the first ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
