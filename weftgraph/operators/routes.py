"""Routes, fetches, response shapes and contracts between repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import prefix_likeness, reason_fetches, reason_keys, route_path
from weftgraph.operators.search import bm25_between, words
from weftgraph.plans.scratch import cut


def listed(routes: DataFrame, method: str | None = None) -> DataFrame:
    """(method, path) from names of the form ``METHOD path``."""
    parts = F.split("name", " ", 2)
    out = routes.select("*", F.upper(F.get(parts, 0)).alias("method"), F.coalesce(F.get(parts, 1), F.lit("")).alias("path"))
    return out.where(F.col("method") == method.upper()) if method else out


def suggestions(routes: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The paths most like one that was not found."""
    return routes.select("path").distinct().withColumn("score", prefix_likeness(F.col("path"), F.lit(path))).where("score > 0").orderBy(F.desc("score"), "path").limit(k)


def inspect_route(graph, path: str, depth: int = 3) -> DataFrame:
    """(route_id, handler, seed, node, depth): the handlers of an exact path and what lies upstream of them.

    A route that nothing handles has its handler written in place: the scope around it is the seed, null if there is none.
    """
    from weftgraph.operators.detect import enclosing
    from weftgraph.operators.traverse import impact

    found = cut(listed(graph.nodes.where(F.col("kind") == "Route")).where(F.col("path") == path).select(F.col("id").alias("route_id"), "file_id", F.col("start_row").alias("line")), "routes")
    handlers = graph.edges.where(F.col("rel_type") == "HandlesRoute").join(found.select(F.col("route_id").alias("dst")), "dst", "left_semi")
    named = handlers.select(F.col("dst").alias("route_id"), F.lit("named").alias("handler"), F.col("src").alias("seed")).distinct()
    bare = found.join(named, "route_id", "left_anti")
    scopes = enclosing(graph.nodes, bare.select("file_id", F.col("route_id").alias("place_id"), "line"))
    inline = bare.select("route_id", F.lit("inline_anonymous").alias("handler")).join(scopes.select(F.col("place_id").alias("route_id"), F.col("id").alias("seed")), "route_id", "left")
    seeds = cut(named.unionByName(inline), "handlers")
    reached = impact(graph, seeds.where("seed IS NOT NULL").select("seed").distinct(), "up", depth).select("seed", "node", "depth")
    above = seeds.join(reached, "seed").select("route_id", "handler", "seed", "node", "depth")
    return seeds.select("route_id", "handler", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).unionByName(above)


def matched_fetches(fetches: DataFrame, routes: DataFrame) -> DataFrame:
    """Fetches (fetch_id, file_id, method, url) joined to routes (route_id, file_id, method, path) on method and path; not within the handler's own file."""
    left = fetches.select("fetch_id", F.col("file_id").alias("fetch_file"), F.upper("method").alias("method"), route_path(F.col("url")).alias("path"))
    right = routes.select("route_id", F.col("file_id").alias("route_file"), F.upper("method").alias("method"), route_path(F.col("path")).alias("path"))
    out = left.join(right, ["method", "path"]).where(~F.col("fetch_file").eqNullSafe(F.col("route_file")))
    return out.select("fetch_id", "route_id", "path", F.when(F.col("path").contains(":*"), 0.6).otherwise(0.8).alias("confidence"))


def shape_drift(consumers: DataFrame, shapes: DataFrame) -> DataFrame:
    """Consumers (edge_id, node_id, reason) whose keys a route's shape (node_id, response_keys, error_keys) lacks."""
    none = F.array().cast("array<string>")
    joined = consumers.join(shapes, "node_id", "left").withColumn("keys", reason_keys(F.col("reason")))
    known = F.col("response_keys").isNotNull() | F.col("error_keys").isNotNull()
    gone = F.array_except("keys", F.array_union(F.coalesce("response_keys", none), F.coalesce("error_keys", none)))
    status = F.when(~F.col("reason").contains("|keys:"), "unparseable").when(~known, "unknown_shape").when(F.size(gone) > 0, "drift").otherwise("ok")
    return joined.select("edge_id", "node_id", status.alias("status"), F.when(status == "drift", F.array_sort(gone)).otherwise(none).alias("missing"), reason_fetches(F.col("reason")).alias("fetches"))


def contract_id(kind: str, *parts) -> F.Column:
    """``http:METHOD:path`` or ``grpc:Service:*``."""
    return F.concat_ws(":", F.lit(kind), *parts, *([F.lit("*")] if kind == "grpc" else []))


def excluded(path: F.Column) -> F.Column:
    """Paths of parameters only, the empty path among them."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.forall(segments, lambda s: s.rlike(r"^(\{[^}]*\}|:[^/]+|<[^>]*>)$"))


def linkable(contracts: DataFrame, paths: tuple[str, ...] = (), param_only: bool = True) -> DataFrame:
    """Contracts that take part in links: not those of the listed paths, nor of paths of parameters only."""
    parts = F.split("contract_id", ":")
    path = F.rtrim(F.get(parts, 2), F.lit("/"))
    out = F.coalesce(path.isin([p.rstrip("/") for p in paths]), F.lit(False)) if paths else F.lit(False)
    out = out | (F.coalesce(excluded(path), F.lit(False)) if param_only else F.lit(False))
    return contracts.where(~out)


def contract_links(contracts: DataFrame, min_score: float = 0.6, candidates: int = 16, exclude: tuple[str, ...] = (), exact_only: bool = False) -> DataFrame:
    """Consumers to providers of other repositories: by equal id with confidence 1, the rest by BM25 over the words of ids.

    ``contracts``: (repo, contract_id, role, symbol). Each contract is a document of the index; the ``candidates`` best
    for a consumer's id are taken, consumers among them, and of these the providers that score ``min_score`` or more.
    """
    kept = cut(linkable(contracts, exclude), "contracts")
    parts = lambda role, n: kept.where(F.col("role") == role).select(F.col("repo").alias(f"{n}_repo"), F.col("symbol").alias(f"{n}_symbol"), F.col("contract_id").alias(f"{n}_id"))
    left, right = parts("consumer", "c"), parts("provider", "p")
    same = left.join(right, F.col("c_id") == F.col("p_id")).where("c_repo <> p_repo").select(*left.columns, *right.columns, F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type"))
    if exact_only:
        return same
    rest = left.join(same.select(*left.columns).distinct(), left.columns, "left_anti")
    # Ids are scored once each, however many contracts have them.
    ids = kept.groupBy(F.col("contract_id").alias("id")).agg(F.count(F.lit(1)).alias("copies"))
    scores = cut(bm25_between(rest.select(F.col("c_id").alias("query")).distinct(), ids, words), "scores")
    listed = rest.join(scores.withColumnRenamed("query", "c_id"), "c_id").join(kept.select(F.col("contract_id").alias("id"), F.col("repo").alias("p_repo"), F.col("symbol").alias("p_symbol"), "role"), "id")
    ranked = listed.withColumn("r", F.row_number().over(Window.partitionBy(*left.columns).orderBy(F.desc(F.round("score", 9)), "p_repo", "id", "p_symbol", "role"))).where(F.col("r") <= candidates)
    near = ranked.where((F.col("role") == "provider") & (F.col("score") >= min_score) & (F.col("c_repo") != F.col("p_repo")))
    return same.unionByName(near.select(*left.columns, "p_repo", "p_symbol", F.col("id").alias("p_id"), F.col("score").alias("confidence"), F.lit("bm25").alias("match_type")))


def group_impact(local: DataFrame, links: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Links between repositories (c_symbol, p_symbol, confidence, ...) that touch a local symbol (symbol), one step far."""
    symbols = local.select("symbol").distinct()
    sure = links.where(F.col("confidence") >= min_confidence)
    ends = sure.join(symbols.withColumnRenamed("symbol", "c_symbol"), "c_symbol", "left_semi").select(*links.columns)
    other = sure.join(symbols.withColumnRenamed("symbol", "c_symbol"), "c_symbol", "left_anti").join(symbols.withColumnRenamed("symbol", "p_symbol"), "p_symbol", "left_semi").select(*links.columns)
    return ends.unionByName(other)


def registry(path: str, contracts: DataFrame | None = None, links: DataFrame | None = None, spark=None) -> tuple[DataFrame, DataFrame]:
    """The contracts and links of a group as stored under ``path``; given ones are written first."""
    for name, df in (("contracts", contracts), ("links", links)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    session = spark or contracts.sparkSession
    return session.read.parquet(f"{path}/contracts"), session.read.parquet(f"{path}/links")


def group_summary(members: DataFrame) -> DataFrame:
    """(repo, nodes, symbols, files) of the nodes (repo, kind) of all members."""
    symbol = F.col("kind").isin("Function", "Method", "Class", "Interface")
    return members.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(symbol).alias("symbols"), F.count_if(F.col("kind") == "File").alias("files"))


def unmatched(contracts: DataFrame, links: DataFrame) -> DataFrame:
    """Contracts with a flag whether any link touches them."""
    touched = links.select(F.col("c_repo").alias("repo"), F.col("c_symbol").alias("symbol")).unionByName(links.select(F.col("p_repo").alias("repo"), F.col("p_symbol").alias("symbol"))).distinct().withColumn("matched", F.lit(True))
    return contracts.join(touched, ["repo", "symbol"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def member_status(members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Status of each member (repo, exists, head_no) against the snapshots (repo, built_no)."""
    behind = F.col("head_no") - F.col("built_no")
    status = F.when(~F.col("exists"), "Missing").when(F.col("built_no").isNull(), "NoSnapshot").when(behind == 0, "Ok").otherwise(F.concat(F.lit("Stale("), behind, F.lit(")")))
    return members.join(snapshots, "repo", "left").select("repo", status.alias("status"))
