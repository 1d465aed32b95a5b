"""Streams of peer events and call records. File offsets live in the checkpoint, so each line is drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.logs import INBOX


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """The inbox as a stream: dirty events and messages in one schema."""
    return spark.readStream.schema(INBOX).option("mode", "DROPMALFORMED").json(path)


def concerns(events: DataFrame, dirty: DataFrame, impacted: DataFrame) -> DataFrame:
    """Dirty events that matter: HARD where the symbol is dirty here too, SOFT where it lies in the impact set.

    ``dirty`` and ``impacted`` are static tables (name); the stream joins them by name.
    """
    marks = dirty.select("name", F.lit(0).alias("rank")).unionByName(impacted.select("name", F.lit(1).alias("rank"))).groupBy("name").agg(F.min("rank").alias("rank"))
    mine = events.where(F.col("type") == "dirty_event").withColumn("name", F.col("symbol.name")).join(marks, "name")
    return mine.select("ts", "peer_session", "name", F.when(F.col("rank") == 0, "HARD").otherwise("SOFT").alias("concern"))


def thread(messages: DataFrame, msg_id: str) -> DataFrame:
    """A message and the replies to it."""
    return messages.where((F.col("type") == "message") & ((F.col("msg_id") == msg_id) | (F.col("reply_to") == msg_id)))


def windowed_calls(calls: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls by tumbling window and tool, with a watermark for late records."""
    w = F.window("ts", width)
    counted = calls.withWatermark("ts", late).groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration").alias("duration"))
    return counted.select(F.col("w.start").alias("hour"), "tool", "calls", "duration")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived to Parquet and stop; run again, it goes on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def watch(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep draining once a second."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
