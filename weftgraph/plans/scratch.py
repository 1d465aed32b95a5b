"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and the master is local, as in tests."""
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.checkpoint.dir"):
        return conf.get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = spark.conf.get("spark.weftgraph.scratch", None)
    if not found:
        spark.conf.set("spark.weftgraph.scratch", found := tempfile.mkdtemp(prefix="weftgraph-"))
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "scratch", by: str | None = None) -> DataFrame:
    """``df`` as a written table, in folders by a column if one is named: its lineage is cut, and a lost executor costs nothing."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
