"""What the corpus operators share: scratch tables in the shared folder, and table readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from weftgraph.plans.scratch import shared_dir

#: Upper bound of code points in the size estimate below; sources without statistics report far more.
UNKNOWN_SIZE = 1 << 50
#: Stands for a null doc_id where rows are joined or ordered.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for tables that nothing reads any more; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(spark: SparkSession, size: int, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of ``size`` bytes: those of the session, more where that is large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def shuffle_partitions(df: DataFrame, times: float = 1.0) -> int:
    """Partitions for a shuffle of ``times`` the bytes of ``df``: those of the session, more where the input is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return partitions_for(df.sparkSession, 0 if size > UNKNOWN_SIZE else int(size * times))


def n_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """A hash of a whole row; maps, which have no hash of their own, count by their entries as JSON."""

    def plain(f: StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        return F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c

    return F.xxhash64(*map(plain, df.schema.fields))
