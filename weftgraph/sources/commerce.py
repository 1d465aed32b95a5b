"""The commerce profile: a property graph over the star schema, derived lazily without copies."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import identifier_tokens
from weftgraph.operators.search import write_postings
from weftgraph.plans.model import Profile, PropertyGraph
from weftgraph.plans.scratch import cut, shared_dir

PROFILE = Profile(
    ("Region", "Nation", "Customer", "Supplier", "Part", "Order"),
    ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY"),
    heuristic=frozenset({"SUPPLIED_BY"}),
    containment=frozenset({"IN_REGION", "IN_NATION"}),
)
#: Ids of a kind begin at its number times this.
STEP = 10**15
KINDS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.lit(KINDS[kind] * STEP) + F.col(key)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str, source: str, key: str, name: Column, size: Column | None = None) -> DataFrame:
        return table(spark, sf_dir, source).select(
            node_id(kind, key).alias("id"), node_id(kind, key).alias("uid"), name.alias("name"), F.lit(kind).alias("kind"), (size if size is not None else F.lit(0.0)).alias("amount"),
            (F.split("p_type", " ") if kind == "Part" else F.array().cast("array<string>")).alias("decorators"), ((F.col("p_size") % 2 == 0) if kind == "Part" else F.lit(False)).alias("is_test"),
        )

    parts = [
        of("Region", "region", "r_regionkey", F.col("r_name")),
        of("Nation", "nation", "n_nationkey", F.col("n_name")),
        of("Customer", "customer", "c_custkey", F.col("c_name"), F.col("c_acctbal")),
        of("Supplier", "supplier", "s_suppkey", F.col("s_name"), F.col("s_acctbal")),
        of("Part", "part", "p_partkey", F.col("p_name"), F.col("p_retailprice")),
        of("Order", "orders", "o_orderkey", F.concat(F.lit("ORDER_"), F.col("o_orderkey")), F.col("o_totalprice")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def of(df: DataFrame, rel: str, no: int, key: Column, src: Column, dst: Column, confidence: Column, reason: Column) -> DataFrame:
        return df.select((F.lit(no * STEP) + key).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), confidence.alias("confidence"), reason.alias("reason"))

    sure, foreign = F.lit(1.0), F.lit("key")
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        of(t("nation"), "IN_REGION", 1, F.col("n_nationkey"), node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey"), sure, foreign),
        of(t("customer"), "IN_NATION", 2, F.col("c_custkey"), node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey"), sure, foreign),
        of(t("supplier"), "IN_NATION", 3, F.col("s_suppkey"), node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey"), sure, foreign),
        of(t("orders"), "PLACED", 4, F.col("o_orderkey"), node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey"), sure, F.col("o_orderstatus")),
        of(t("lineitem"), "CONTAINS", 5, F.col("l_orderkey") * 10 + F.col("l_linenumber"), node_id("Order", "l_orderkey"), node_id("Part", "l_partkey"), 1 - F.col("l_discount"), F.col("l_returnflag")),
        of(supplied, "SUPPLIED_BY", 6, F.col("l_partkey") * 100_000 + F.col("l_suppkey"), node_id("Part", "l_partkey"), node_id("Supplier", "l_suppkey"), F.lit(0.5), F.lit("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_stores: dict = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of each table's files: a store of other files is another store."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for name in TABLES:
        path = hadoop(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append((fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()))
    return tuple(out)


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables, written once for each session to the shared folder, nodes by kind and edges by relation.

    So a scan reads the kinds and relations asked for, and pairs of order lines are made distinct once.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _stores:
        stored = lambda df, by: cut(df, "graph", by).select(*df.columns)
        _stores[key] = PropertyGraph(stored(nodes(spark, sf_dir), "kind"), stored(edges(spark, sf_dir), "rel_type"), PROFILE)
    return _stores[key]


def name_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an inverted index of the nodes' names, written once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), "names")
    if key not in _stores:
        path = f"{shared_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
        write_postings(graph(spark, sf_dir).nodes, "id", identifier_tokens(F.col("name")), path)
        _stores[key] = path
    return _stores[key]


#: The same graph as common table expressions of DuckDB, to hold results against.
SQL = f"""
nodes AS (
  SELECT {STEP} + r_regionkey AS id, r_name AS name, 'Region' AS kind, 0.0::DOUBLE AS amount, CAST([] AS VARCHAR[]) AS decorators, false AS is_test FROM region
  UNION ALL SELECT {2 * STEP} + n_nationkey, n_name, 'Nation', 0.0, [], false FROM nation
  UNION ALL SELECT {3 * STEP} + c_custkey, c_name, 'Customer', c_acctbal, [], false FROM customer
  UNION ALL SELECT {4 * STEP} + s_suppkey, s_name, 'Supplier', s_acctbal, [], false FROM supplier
  UNION ALL SELECT {5 * STEP} + p_partkey, p_name, 'Part', p_retailprice, string_split(p_type, ' '), p_size % 2 = 0 FROM part
  UNION ALL SELECT {6 * STEP} + o_orderkey, 'ORDER_' || o_orderkey, 'Order', o_totalprice, [], false FROM orders),
edges AS (
  SELECT {STEP} + n_nationkey AS edge_id, {2 * STEP} + n_nationkey AS src, {STEP} + n_regionkey AS dst, 'IN_REGION' AS rel_type, 1.0::DOUBLE AS confidence, 'key' AS reason FROM nation
  UNION ALL SELECT {2 * STEP} + c_custkey, {3 * STEP} + c_custkey, {2 * STEP} + c_nationkey, 'IN_NATION', 1.0, 'key' FROM customer
  UNION ALL SELECT {3 * STEP} + s_suppkey, {4 * STEP} + s_suppkey, {2 * STEP} + s_nationkey, 'IN_NATION', 1.0, 'key' FROM supplier
  UNION ALL SELECT {4 * STEP} + o_orderkey, {3 * STEP} + o_custkey, {6 * STEP} + o_orderkey, 'PLACED', 1.0, o_orderstatus FROM orders
  UNION ALL SELECT {5 * STEP} + l_orderkey * 10 + l_linenumber, {6 * STEP} + l_orderkey, {5 * STEP} + l_partkey, 'CONTAINS', 1 - l_discount, l_returnflag FROM lineitem
  UNION ALL SELECT {6 * STEP} + l_partkey * 100000 + l_suppkey, {5 * STEP} + l_partkey, {4 * STEP} + l_suppkey, 'SUPPLIED_BY', 0.5, 'line' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
"""
