"""Record logs as JSON lines, each with an explicit schema; lines that do not parse are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = "ts STRING, tool STRING, duration_ms BIGINT, ok BOOLEAN, source STRING, error_kind STRING, subcommand STRING, error_msg STRING"
INBOX = "type STRING, ts STRING, peer_session STRING, peer_pid BIGINT, kind STRING, symbol STRUCT<name:STRING,kind:STRING,file:STRING,line_start:INT,line_end:INT>, reason STRING, msg_id STRING, `from` STRING, `to` STRING, reply_to STRING, body STRING"
BINDINGS = "src_file STRING, name STRING, specifier STRING, tier STRING, target_file STRING, alt_count INT, confidence FLOAT"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Call records (ts, tool, duration, ok, error_kind); a missing tool is ``unknown``, a missing ok is true."""
    raw = json_lines(spark, path, TELEMETRY)
    return raw.select(F.try_to_timestamp("ts").alias("ts"), F.coalesce("tool", F.lit("unknown")).alias("tool"), F.col("duration_ms").cast("double").alias("duration"), F.coalesce("ok", F.lit(True)).alias("ok"), "error_kind").where("ts IS NOT NULL")


def bindings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, BINDINGS)
