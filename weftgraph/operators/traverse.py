"""Breadth-first traversal of many seeds at once.

Each level is an equi-join of the frontier with the edges, a partial aggregation that picks the discovering edge,
and an anti-join with what was seen. State is keyed by (seed, node), so hot seeds and hubs spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scratch import cut


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (from, to, way, ...): ``out`` follows them, ``in`` goes against them, ``both`` does either, in-edges first."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(1).alias("way"), *cols)
    back = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0).alias("way"), *cols)
    return {"out": out, "in": back}.get(direction) or (back.unionByName(out) if direction == "both" else _unknown(direction))


def _unknown(direction: str):
    raise ValueError(f"direction must be out, in or both, not {direction}")


def reach(seeds: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int | None = None, allowed: DataFrame | None = None, limit: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(seed, node, depth, via, parent) and the ``carry`` columns of the discovering edge, of every node within ``max_depth`` of a seed, each at its least depth.

    The seed itself has depth 0. ``via`` is the edge of discovery: that of the parent found first, then the smaller
    way and edge_id, as a queue would take them. ``allowed`` holds the ids that may be reached and gone on from.
    """
    ways = directed(edges.select("edge_id", "src", "dst", *carry), direction)
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    empty = F.array().cast("array<long>")
    first = cut(seeds.select(F.col("seed").cast("long").alias("seed"), F.col("seed").cast("long").alias("node")).distinct().select("seed", "node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("parent"), empty.alias("turn"), *(F.lit(None).cast(kinds[c]).alias(c) for c in carry)), "reach")
    frontier, levels, depth = first, [first], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        turn = F.concat("turn", F.array(F.col("way").cast("long"), F.col("edge_id")))
        step = frontier.drop(*carry).join(ways, F.col("node") == F.col("from")).select("seed", F.col("to").alias("next"), F.struct(turn.alias("turn"), F.col("edge_id").alias("via"), F.col("node").alias("parent"), *carry).alias("how"))
        found = step.groupBy("seed", "next").agg(F.min("how").alias("how")).withColumnRenamed("next", "node")
        if allowed is not None:
            found = found.join(allowed.select(F.col("id").alias("node")), "node", "left_semi")
        seen = reduce(DataFrame.union, (level.select("seed", "node") for level in levels))
        found = found.join(seen, ["seed", "node"], "left_anti")
        frontier = cut(found.select("seed", "node", F.lit(depth).alias("depth"), F.col("how.via").alias("via"), F.col("how.parent").alias("parent"), F.col("how.turn").alias("turn"), *(F.col(f"how.{c}").alias(c) for c in carry)), "reach")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    if limit is not None:  # the feature of a capped traversal: nearest first
        out = out.orderBy("depth", "turn").limit(limit)
    return out.select("seed", "node", "depth", "via", "parent", *carry)


def callers_of(graph, start: int, max_depth: int, relations: list[str] | None = None, limit: int | None = 10_000) -> DataFrame:
    """Nodes that reach ``start`` against the edges, with their depths."""
    return _from_one(graph, start, "in", max_depth, relations, limit)


def callees_of(graph, start: int, max_depth: int, relations: list[str] | None = None, limit: int | None = 10_000) -> DataFrame:
    """Nodes that ``start`` reaches along the edges, with their depths."""
    return _from_one(graph, start, "out", max_depth, relations, limit)


def _from_one(graph, start: int, direction: str, max_depth: int, relations: list[str] | None, limit: int | None) -> DataFrame:
    edges = graph.edges if relations is None else graph.edges.where(F.col("rel_type").isin(relations))
    seed = graph.nodes.sparkSession.range(1).select(F.lit(start).cast("long").alias("seed"))
    return reach(seed, edges, direction, max_depth, limit=limit).select("node", "depth")


def eligible(graph, min_confidence: float = 0.0, relations: list[str] | None = None, heuristic: bool = False) -> Column:
    """Edges along which influence flows."""
    fine = (F.col("confidence") >= min_confidence) & ~F.col("rel_type").isin(sorted(graph.profile.containment)) if graph.profile.containment else F.col("confidence") >= min_confidence
    if not heuristic and graph.profile.heuristic:
        fine = fine & ~F.col("rel_type").isin(sorted(graph.profile.heuristic))
    return fine & F.col("rel_type").isin(relations) if relations else fine


def impact(graph, seeds: DataFrame, direction: str = "up", depth: int = 5, min_confidence: float = 0.0, relations: list[str] | None = None, heuristic: bool = True, tests: bool = True) -> DataFrame:
    """(seed, node, depth, via, rel_type, bucket): what a change of the seeds touches.

    ``bucket`` is ``heuristic`` where the discovering edge is a guess. Nodes without a file, and without ``tests``
    those in test files, are neither reached nor gone on from.
    """
    way = {"up": "in", "down": "out", "both": "both"}[direction]
    edges = graph.edges.where(eligible(graph, min_confidence, relations, heuristic))
    allowed = None
    if graph.files is not None:
        allowed = graph.nodes.where(F.col("file_id").isNotNull())
        if not tests:
            allowed = allowed.join(graph.files.where(F.col("category") == "Test"), "file_id", "left_anti")
        seeds = seeds.join(allowed.select(F.col("id").alias("seed")), "seed", "left_semi")
    found = reach(seeds, edges, way, depth, allowed, carry=("rel_type",)).where("depth > 0")
    guess = F.col("rel_type").isin(sorted(graph.profile.heuristic)) if graph.profile.heuristic else F.lit(False)
    return found.select("seed", "node", "depth", "via", "rel_type", F.when(guess, "heuristic").otherwise("deterministic").alias("bucket"))


def hidden_edges(graph, reached: DataFrame, direction: str = "up", min_confidence: float = 0.0) -> DataFrame:
    """(seed, low_confidence, heuristic): edges at the expanded nodes that were left out, by reason."""
    ways = directed(graph.edges, {"up": "in", "down": "out", "both": "both"}[direction])
    guess = F.col("rel_type").isin(sorted(graph.profile.heuristic)) if graph.profile.heuristic else F.lit(False)
    low = F.col("confidence") < min_confidence
    return reached.join(ways, F.col("node") == F.col("from")).groupBy("seed").agg(F.count_if(low).alias("low_confidence"), F.count_if(~low & guess).alias("heuristic"))


def coverage(impacted: DataFrame, is_test: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, production, tests, coverage) from the callers upstream of each seed."""
    callers = impacted.join(is_test.select(F.col("id").alias("node"), "is_test"), "node").groupBy("seed").agg(F.count_if("is_test").alias("tests"), F.count_if(~F.col("is_test")).alias("production"))
    both = seeds.select("seed").join(callers, "seed", "left").select("seed", F.coalesce("production", F.lit(0)).alias("production"), F.coalesce("tests", F.lit(0)).alias("tests"))
    label = F.when((F.col("production") == 0) & (F.col("tests") == 0), "Orphan").when(F.col("tests") == 0, "Uncovered").when(F.col("production") > 3 * F.col("tests"), "Partial").otherwise("Covered")
    return both.withColumn("coverage", label)


def resolve_targets(graph, name: str, kind: str | None = None, file: str | None = None) -> DataFrame:
    """Nodes of a name, or of ``Owner.name``, by kind and part of the path. Several without a filter are an error."""
    view = graph.node_view()
    owner, _, last = name.rpartition(".")
    found = view.where((F.col("name") == name) | ((F.col("name") == last) & (F.col("owner_class") == owner)) if owner else F.col("name") == name)
    if kind:
        found = found.where(F.lower("kind") == kind.lower())
    if file:
        found = found.where(F.col("file_path").contains(file))
    if not kind and not file and (n := len(found.select("id").take(2))) > 1:
        raise ValueError(f"{name} names {n} or more nodes; give a kind or a file")
    return found


def test_coverage(graph, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Coverage of the seeds by the tests upstream of them."""
    reached = impact(graph, seeds, "up", depth)
    is_test = graph.node_view().select("id", (F.col("is_test") | F.coalesce(F.col("category") == "Test", F.lit(False))).alias("is_test"))
    return coverage(reached, is_test, seeds)
