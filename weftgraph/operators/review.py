"""Review of a change: changed symbols and what they touch, differences of contracts, and findings of all sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import diff
from weftgraph.operators.traverse import impact
from weftgraph.plans.scratch import cut

KEY = ["path", "kind", "name"]


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, name, line, change) of symbols (path, kind, name, line, line_hash): added, modified or removed.

    Files and processes are no symbols; of equal keys in one snapshot the last by line counts; removed ones have line 0.
    """

    def last(x: DataFrame) -> DataFrame:
        return x.where(~F.col("kind").isin("File", "Process")).groupBy(*KEY).agg(F.max(F.struct("line", "line_hash")).alias("m")).select(*KEY, "m.line", "m.line_hash")

    found = diff.keyed(last(old), last(new), KEY, F.col("old.line_hash") != F.col("new.line_hash"))
    change = F.when(F.col("status") == "changed", "modified").otherwise(F.col("status"))
    return found.select(*KEY, F.coalesce("new.line", F.lit(0)).alias("line"), change.alias("change"))


def impact_of_changes(graph, places: DataFrame, changes: DataFrame, direction: str = "up", depth: int = 5, min_confidence: float = 0.0, relations: list[str] | None = None, heuristic: bool = True, tests: bool = True) -> DataFrame:
    """(seed, change, section, node, depth, bucket): what each changed symbol that the graph holds touches, from all of them at once.

    ``places`` gives the graph's nodes as (id, path, kind, name); of equal keys the last id counts. A symbol that
    nothing sure calls shows its direct callees instead, in the section ``downstream``.
    """
    held = places.groupBy(*KEY).agg(F.max("id").alias("seed"))
    seeds = cut(changes.join(held, KEY).select("seed", "change"), "changed")
    found = cut(impact(graph, seeds.select("seed"), direction, depth, min_confidence, relations, heuristic, tests), "impact")
    out = found.select("seed", F.lit("impact").alias("section"), "node", "depth", "bucket")
    if direction == "up":
        called = found.where("bucket = 'deterministic'").select("seed").distinct()
        orphans = seeds.select("seed").join(called, "seed", "left_anti")
        down = impact(graph, orphans, "down", 1, min_confidence, relations, heuristic, tests)
        out = out.unionByName(down.select("seed", F.lit("downstream").alias("section"), "node", "depth", "bucket"))
    return seeds.join(out, "seed").select("seed", "change", "section", "node", "depth", "bucket")


def blind_spot_warning(targets: DataFrame, spots: DataFrame) -> DataFrame:
    """(id, kind, n): blind spots (kind, file_path) by kind in the file of each target (id, file_path)."""
    counts = spots.join(targets.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return targets.select("id", "file_path").join(counts, "file_path").select("id", "kind", "n")


def literal_sites(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(id, enclosing, sink_reason): the sites of a path literal, with the symbol and reason of the last edge that uses each."""
    sites = nodes.where((F.col("kind") == "PathLiteral") & (F.col("name") == value)).select("id")
    uses = edges.where(F.col("rel_type") == "UsesPathLiteral").join(sites.select(F.col("id").alias("dst")), "dst", "left_semi")
    last = uses.groupBy(F.col("dst").alias("id")).agg(F.max_by(F.struct("src", "reason"), "edge_id").alias("u"))
    names = nodes.select(F.col("id").alias("src"), F.col("name").alias("enclosing"))
    return sites.join(last.select("id", "u.src", "u.reason"), "id", "left").join(names, "src", "left").select("id", "enclosing", F.coalesce("reason", F.lit("")).alias("sink_reason"))


def contracts(routes: DataFrame, shapes: DataFrame, fetches: DataFrame) -> DataFrame:
    """(kind, identifier, schema_keys) of a snapshot's routes (id, name) and fetches (edge_id, reason, src_name).

    A fetch is known by its reason, or by the caller's name where that is empty; of equal ones the last counts.
    """
    none = F.array().cast("array<string>")
    of_routes = routes.join(shapes.select(F.col("node_id").alias("id"), "response_keys"), "id", "left").select(F.lit("route").alias("kind"), F.col("name").alias("identifier"), F.col("id").alias("turn"), F.coalesce("response_keys", none).alias("schema_keys"))
    name = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.col("src_name"), F.lit(""))
    of_fetches = fetches.select(F.lit("fetch").alias("kind"), name.alias("identifier"), F.col("edge_id").alias("turn"), none.alias("schema_keys"))
    return of_routes.unionByName(of_fetches).groupBy("kind", "identifier").agg(F.max_by("schema_keys", "turn").alias("schema_keys"))


def contracts_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, identifier, status) of contracts that were added, removed or modified in their keys."""
    found = diff.keyed(old, new, ["kind", "identifier"], F.col("old.schema_keys") != F.col("new.schema_keys"))
    return found.select("kind", "identifier", F.when(F.col("status") == "changed", "modified").otherwise(F.col("status")).alias("status"))


def sections(old: dict[str, DataFrame], new: dict[str, DataFrame], explicit: bool = False, same: bool = False) -> dict[str, DataFrame]:
    """The sections of a difference of two snapshots of tables ``symbols``, ``routes``, ``contracts`` and ``bindings``.

    Two snapshots that are named explicitly have no section of bindings; two equal references have only empty sections.
    """
    each = {"symbols": diff.symbols, "routes": diff.routes, "contracts": contracts_diff} | ({} if explicit else {"bindings": diff.bindings})
    out = {name: f(old[name], new[name]) for name, f in each.items() if name in old and name in new}
    return {name: df.limit(0) for name, df in out.items()} if same else out


# --- findings: (section, path, line, severity, detail)


def _finding(rows: DataFrame, section: str, severity: str, line: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), "path", line.cast("long").alias("line"), F.lit(severity).alias("severity"), detail.alias("detail"))


def blind_spot_findings(spots: DataFrame) -> DataFrame:
    """Of blind spots (kind, path, start_row)."""
    return _finding(spots, "blind_spot", "info", F.col("start_row"), F.concat(F.lit("blind spot: "), "kind"))


def egress_findings(calls: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Of external calls (path, line, callee, package), on added lines (path, line) only where these are known."""
    on = calls if added is None else calls.join(added.select("path", "line").distinct(), ["path", "line"], "left_semi")
    return _finding(on, "egress", "info", F.col("line"), F.concat(F.lit("external call: "), "callee", F.lit(" (package: "), "package", F.lit(")")))


def drift_findings(drift: DataFrame) -> DataFrame:
    """Of consumers (path, line, status, missing) whose keys a route lacks."""
    return _finding(drift.where("status = 'drift'"), "shape_drift", "warn", F.col("line"), F.concat(F.lit("missing keys: "), F.array_join("missing", ", ")))


def tier_findings(changed: DataFrame) -> DataFrame:
    """Of changed bindings (path, name, before, after): any change of the resolver's tier, improvements too."""
    moved = changed.where(~F.col("before").eqNullSafe(F.col("after")))
    return _finding(moved, "resolver", "warn", F.lit(0), F.concat("name", F.lit(": "), F.coalesce("before", F.lit("none")), F.lit(" -> "), F.coalesce("after", F.lit("none"))))


def literal_findings(pairs: DataFrame, scope: DataFrame) -> DataFrame:
    """Of literal pairs (read, written, read_path, write_path, write_line), either side in scope, each at the first place that writes it."""
    sides = pairs.select("read", "written", F.explode(F.array("read_path", "write_path")).alias("path")).distinct()
    inside = diff.in_scope(sides, "path", scope).select("read", "written").distinct()
    first = pairs.join(inside, ["read", "written"], "left_semi").groupBy("read", "written").agg(F.min(F.struct(F.col("write_path").alias("path"), F.col("write_line").alias("line"))).alias("w"))
    return _finding(first.select("read", "written", "w.path", "w.line"), "literal", "warn", F.col("line"), F.concat(F.lit("reads "), "read", F.lit(" but writes "), "written"))
