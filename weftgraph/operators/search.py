"""Lexical search: exact and fuzzy names, Okapi BM25, substring ranking, buckets, and fusion of rankings."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import identifier_tokens
from weftgraph.plans.scratch import cut

K1, B = 1.2, 0.75
#: Order in which categories are shown.
CATEGORIES = ("Source", "Test", "Example", "Document", "Config", "Reference")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def bm25(rows: DataFrame, key: str, tokens: Column, terms: list[str]) -> DataFrame:
    """(key, score) of the rows that hold any of the terms. Only their occurrences are exploded, not whole texts."""
    terms = sorted(set(terms))
    listed = rows.select(F.col(key), tokens.alias("tokens"))
    sized = listed.select(key, F.size("tokens").alias("size"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits"))
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    counts = sized.select(key, "size", F.explode("hits").alias("term")).groupBy(key, "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _scored(counts, total, key)


#: Folders of a stored index; a term's folder follows from its hash.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, key: str, tokens: Column, path: str) -> None:
    """An inverted index: (term, key, tf, size) in folders by the term's hash, and the number and mean size of the rows."""
    sized = rows.select(F.col(key).alias("key"), tokens.alias("tokens")).select("key", "tokens", F.size("tokens").alias("size"))
    counts = sized.select("key", "size", F.explode("tokens").alias("term")).groupBy("key", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    sized.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).write.mode("overwrite").parquet(f"{path}/total")


def bm25_stored(spark: SparkSession, path: str, terms: list[str], k: int | None = 100) -> DataFrame:
    """(key, score, total) of the k best rows of a stored index for any of the terms, and how many there are in all; all rows and no total without k.

    Only the folders and row groups of the terms are read.
    """
    terms = sorted(set(terms))
    places = spark.range(1).select(*(_bucket(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms))).first() if terms else ()  # of the query only
    held = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted(set(places))) & F.col("term").isin(terms)).drop("bucket")
    scored = _scored(held, spark.read.parquet(f"{path}/total"), "key")
    if k is None:
        return scored
    scored = cut(scored, "scores")
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    return scored.orderBy(F.desc("score"), "key").limit(k).crossJoin(F.broadcast(total))  # one row


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _scored(counts: DataFrame, total: DataFrame, *by: str) -> DataFrame:
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = counts.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(total))  # as many rows as terms; one row
    return joined.groupBy(*by).agg(F.sum(_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("size"), F.col("mean"))).alias("score"))


def bm25_between(queries: DataFrame, texts: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(query, id, score) of all texts (id, copies) that share a term with a query (query); ``tokens`` splits both.

    A text with several copies counts as so many documents. Postings are aggregated by text and term before they meet.
    """
    sized = texts.select("id", "copies", tokens(F.col("id")).alias("t")).select("id", "copies", "t", F.size("t").alias("size"))
    total = sized.agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("size")) / F.sum("copies")).alias("mean"))
    held = sized.select("id", "copies", "size", F.explode("t").alias("term")).groupBy("id", "copies", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = held.groupBy("term").agg(F.sum("copies").alias("df"))
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    met = asked.join(held, "term").join(frequency, "term").crossJoin(F.broadcast(total))  # one row
    return met.groupBy("query", "id").agg(F.sum(_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("size"), F.col("mean"))).alias("score"))


def merged_hits(hits: list[DataFrame], k: int = 100) -> DataFrame:
    """The k best of the hits (repo, id, score) of several repositories."""
    return reduce(DataFrame.unionByName, [h.select("repo", "id", "score") for h in hits]).orderBy(F.desc("score"), "repo", "id").limit(k)


def prompt_terms(prompt: str) -> list[str]:
    """What a prompt asks for: its words that look like identifiers, longer than two letters, each once."""
    return list(dict.fromkeys(w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", prompt)))


def identifier_terms(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query, split like identifiers."""
    each = spark.range(1).select(F.explode(F.array_distinct(F.flatten(F.transform(F.split(F.lit(query), r"\s+"), identifier_tokens)))).alias("t"))
    return [r["t"] for r in each.collect()]  # of the query only


def bm25_names(nodes: DataFrame, query: str) -> DataFrame:
    """BM25 over identifier tokens of node names; the query is split in the same way."""
    return bm25(nodes, "id", identifier_tokens(F.col("name")), identifier_terms(nodes.sparkSession, query))


def substring_rank(rows: DataFrame, name: str, needle: str) -> DataFrame:
    """Rows whose name holds the needle in any case, with 1.0 for the whole, 0.7 for a start, 0.4 elsewhere."""
    n, x = F.lower(F.col(name)), needle.lower()
    return rows.where(n.contains(x)).withColumn("score", F.when(n == x, 1.0).when(n.startswith(x), 0.7).otherwise(0.4))


def bucketed(rows: DataFrame, bucket: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each bucket."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("rank") <= k)


def fused(rankings: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rows (list, key, rank from 1)."""
    return rankings.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def find(graph, pattern: str, fuzzy: bool = False, everything: bool = False) -> DataFrame:
    """Nodes by name: exact, or fuzzy by substring without test files. By category, then callers, then path."""
    view = graph.node_view({"file_path", "category"})
    hits = view.where(F.col("name").contains(pattern) & (F.coalesce(F.col("category"), F.lit("")) != "Test")) if fuzzy else view.where(F.col("name") == pattern)
    callers = graph.edges.join(hits.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.lit(99))
    out = hits.join(callers, "id", "left").select("id", "name", "kind", "file_path", F.coalesce("callers", F.lit(0)).alias("callers"), place.alias("place"))
    out = out.orderBy("place", F.desc("callers"), "file_path", "id").drop("place")
    return out if everything else out.limit(1)


def enriched(graph, hits: DataFrame) -> DataFrame:
    """Hits (id, ...) with the numbers of callers and callees and the first three names of each."""
    names = graph.nodes.select("id", "name")

    def side(own: str, other: str, title: str) -> DataFrame:
        near = graph.edges.join(hits.select(F.col("id").alias(own)), own, "left_semi").join(names.withColumnRenamed("id", other), other)
        # Counts are summed before the shuffle and the first three are picked before it too, so a hub's neighbours never meet in one task.
        counts = near.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias(f"{title}s"))
        ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(own).orderBy("edge_id"))).where(F.col("r") <= 3)
        first = ranked.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("first")).select("id", F.transform("first", lambda x: x["name"]).alias(f"first_{title}s"))
        return counts.join(first, "id")

    out = hits.join(side("dst", "src", "caller"), "id", "left").join(side("src", "dst", "callee"), "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("callers", "callees")} | {c: F.coalesce(c, none) for c in ("first_callers", "first_callees")})


def batch(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, name, score, rank): the k best rows (id, name) by BM25 for each line of ``queries`` (query); blank lines and comments are skipped.

    Names are scored once each, however many rows have them; of a name the k rows with the smallest ids can be among the best.
    """
    asked = queries.select(F.trim("query").alias("query")).where((F.col("query") != "") & ~F.col("query").startswith("#")).distinct()
    names = rows.groupBy(F.col("name").alias("id")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    scored = bm25_between(asked, names, identifier_tokens).join(names.select("id", "least"), "id").withColumn("score", F.round("score", 9))
    best = bucketed(scored, "query", k, F.desc("score"), F.col("least")).select("query", F.col("id").alias("name"), "score")
    first = bucketed(rows.select("id", "name"), "name", k, F.col("id")).drop("rank")
    return bucketed(best.join(first, "name").select("query", "id", "name", "score"), "query", k, F.desc("score"), F.col("id"))
