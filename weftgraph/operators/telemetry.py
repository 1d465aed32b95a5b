"""Aggregates over call records (ts, tool, duration, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile(values: Column, p: int) -> Column:
    """The value at index floor((n - 1) * p / 100) of the sorted ones."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor((F.size(ordered) - 1) * p / 100).cast("int") + 1)


def by_tool(calls: DataFrame) -> DataFrame:
    """Calls, p50, p99 and error rate of each tool. Equal durations are counted first, so a tool's values stay few."""
    counted = calls.groupBy("tool", "duration").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    runs = counted.groupBy("tool").agg(F.sum("n").alias("calls"), F.sum("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("duration", "n"))).alias("runs"))

    def at(p: int) -> Column:
        index = F.floor((F.col("calls") - 1) * p / 100)
        seen = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v")), lambda a, r: F.struct((a["n"] + r["n"]).alias("n"), F.coalesce(a["v"], F.when(a["n"] + r["n"] > index, r["duration"])).alias("v")))
        return seen["v"]

    return runs.select("tool", "calls", at(50).alias("p50"), at(99).alias("p99"), F.round(F.col("bad") / F.col("calls"), 4).alias("error_rate"))


def hourly(calls: DataFrame) -> DataFrame:
    """(hour, calls) with every hour between the first and the last."""
    counts = calls.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("calls"))
    hours = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("calls", F.lit(0)).alias("calls"))


def since(records: DataFrame, cutoff: str) -> DataFrame:
    """Records from a moment on; a missing tool is ``unknown``, a missing ok is true."""
    return records.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(cutoff))).withColumns({"tool": F.coalesce("tool", F.lit("unknown")), "ok": F.coalesce("ok", F.lit(True))})


def usage(calls: DataFrame, budget: float = 30.0) -> DataFrame:
    """By tool: calls, errors and the share within the time budget."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg(F.when(F.col("duration") <= budget, 1.0).otherwise(0.0)), 6).alias("within_budget"))


def errors_by_kind(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("ok")).groupBy("error_kind").agg(F.count(F.lit(1)).alias("errors"))
