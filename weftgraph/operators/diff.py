"""Differences of two snapshots, verdicts and findings on them, overlays and incremental decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that take no part in a symbol diff.
SKIPPED = ("File", "Document", "Section", "Process", "EntryPoint", "Import")


def keyed(old: DataFrame, new: DataFrame, keys: list[str], changed: Column) -> DataFrame:
    """Full outer join on the keys with ``status`` added, removed or changed; unchanged rows go. Sides are ``old`` and ``new`` structs."""
    a = old.select(*keys, F.struct(*old.columns).alias("old"))
    b = new.select(*keys, F.struct(*new.columns).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed, "changed")
    return a.join(b, keys, "full_outer").withColumn("status", status).where(F.col("status").isNotNull())


def symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, owner, name, kind, status) of symbols; added and removed only within files that both have. Of equal keys the first counts."""
    keys = ["path", "owner", "name", "kind"]

    def prepared(x: DataFrame) -> DataFrame:
        return x.where(~F.col("kind").isin(*SKIPPED)).groupBy("path", F.coalesce("owner", F.lit("")).alias("owner"), "name", "kind").agg(F.min_by("content_hash", "id").alias("content_hash"))

    shared = old.select("path").distinct().join(new.select("path").distinct(), "path", "left_semi")
    found = keyed(prepared(old), prepared(new), keys, F.col("old.content_hash") != F.col("new.content_hash"))
    return found.join(shared, "path", "left_semi").select(*keys, "status")


def files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files that only one snapshot has."""
    a, b = old.select("path").distinct(), new.select("path").distinct()
    return b.join(a, "path", "left_anti").withColumn("status", F.lit("added")).unionByName(a.join(b, "path", "left_anti").withColumn("status", F.lit("removed")))


def callers(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, intra, cross, min_confidence): callers of the changed nodes, in the same file and in others."""
    place = nodes.select("id", "file_id")
    into = edges.where(F.col("rel_type").isin("Calls", "References")).join(changed.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = into.join(place.select(F.col("id").alias("dst"), F.col("file_id").alias("f")), "dst").join(place.select(F.col("id").alias("src"), F.col("file_id").alias("g")), "src")
    same = F.col("f").eqNullSafe(F.col("g"))
    return ends.groupBy(F.col("dst").alias("id")).agg(F.count_if(same).alias("intra"), F.count_if(~same).alias("cross"), F.min("confidence").alias("min_confidence"))


def route_consumers(routes_: DataFrame, fetches: DataFrame) -> DataFrame:
    """Routes (id, method, path, file, line) with ``consumers``: files that fetch them (route_id, path, confidence), each once with its greatest confidence."""
    best = fetches.groupBy("route_id", "path").agg(F.max("confidence").alias("confidence"))
    held = best.groupBy(F.col("route_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "confidence"))).alias("consumers"))
    none = F.array().cast(held.schema["consumers"].dataType)
    return routes_.join(held, "id", "left").withColumn("consumers", F.coalesce("consumers", none))


def routes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(method, path, status) of routes (method, path, file, line, consumers); moving the handler is a change, consumers are not."""
    return keyed(old, new, ["method", "path"], (F.col("old.file") != F.col("new.file")) | (F.col("old.line") != F.col("new.line"))).select("method", "path", "status")


def bindings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src_file, name, change) of bindings (src_file, name, target_file, tier); a new target counts before a new tier."""
    keys = ["src_file", "name"]
    moved, tier = ~F.col("old.target_file").eqNullSafe(F.col("new.target_file")), ~F.col("old.tier").eqNullSafe(F.col("new.tier"))
    found = keyed(old, new, keys, moved | tier)
    return found.select(*keys, F.when(F.col("status") != "changed", F.when(F.col("status") == "added", "new").otherwise("removed")).when(moved, "target_change").otherwise("tier_change").alias("change"))


def region(file_changes: DataFrame, symbol_changes: DataFrame) -> DataFrame:
    """(path): files that came or went, and those of symbols that came, went or changed."""
    return file_changes.select("path").unionByName(symbol_changes.select("path")).distinct()


def spots_in_region(spots: DataFrame, region_: DataFrame) -> DataFrame:
    """Blind spots (file_path, start_row, kind, hint, is_test) of the newer snapshot in files of the region; those of tests are left out."""
    inside = spots.where(~F.coalesce("is_test", F.lit(False))).join(region_.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return inside.select(F.col("file_path").alias("path"), "start_row", "kind", "hint")


def indirect_in_region(call_meta: DataFrame, edges: DataFrame, nodes: DataFrame, region_: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(edge_id, dispatch): dynamic dispatch and callbacks out of files (file_id) of the region; dynamic dispatch comes first.

    ``tests``: (node_id, is_test) of functions; calls out of tests are left out.
    """
    dispatch = F.when(F.col("is_dynamic_dispatch"), "dynamic_dispatch").when(F.col("is_callback"), "callback")
    inside = nodes.join(region_, "file_id", "left_semi").select(F.col("id").alias("src"))
    if tests is not None:
        inside = inside.join(tests.where("is_test").select(F.col("node_id").alias("src")), "src", "left_anti")
    return call_meta.join(edges.select("edge_id", "src"), "edge_id").join(inside, "src", "left_semi").select("edge_id", dispatch.alias("dispatch")).where("dispatch IS NOT NULL")


# Severities in rising order.
LEVELS = ("Info", "Warn", "Risk")


def verdicts(changed: DataFrame) -> DataFrame:
    """Rows (status, public, intra, cross) with a ``verdict``: what callers stand to lose decides."""
    calls = F.when(F.col("cross") > 0, "Risk").when(F.col("intra") > 0, "Warn").otherwise("Info")
    gone = F.when(F.col("public"), "Risk").otherwise(calls)
    return changed.withColumn("verdict", F.when(F.col("status") == "changed", calls).when(F.col("status") == "removed", gone).otherwise("Info"))


def route_verdicts(changed: DataFrame) -> DataFrame:
    """Rows (status, consumers): a removed route is a risk, a modified one a warning, or a risk with consumers."""
    return changed.withColumn("verdict", F.when(F.col("status") == "removed", "Risk").when(F.col("status") == "changed", F.when(F.col("consumers") > 0, "Risk").otherwise("Warn")).otherwise("Info"))


def worst(verdict: Column) -> Column:
    """The most severe of a group."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), verdict)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.max(rank).cast("int"))


def in_scope(rows: DataFrame, path: str, scope: DataFrame) -> DataFrame:
    """Rows whose path is an entry of the scope or ends in one: an equi-join on every suffix of the path at a slash."""
    parts = F.split(F.col(path), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    key = rows.withColumn("_end", F.explode(ends)).join(scope.select(F.col("entry").alias("_end")), "_end", "left_semi")
    return rows.join(key.select(path).distinct(), path, "left_semi")


def findings(*parts: DataFrame) -> DataFrame:
    """One list (section, path, severity, detail), the worst first."""
    every = reduce(DataFrame.unionByName, [p.select("section", "path", "severity", "detail") for p in parts])
    rank = F.array_position(F.array(*map(F.lit, ("info", "warn", "risk"))), F.col("severity"))
    return every.orderBy(rank.desc(), "section", "path", "detail")


def impact_findings(caller_counts: DataFrame, least: int = 4) -> DataFrame:
    return caller_counts.where(F.col("callers") >= least).select(F.lit("impact").alias("section"), "path", F.lit("info").alias("severity"), F.concat(F.col("name"), F.lit(" has "), F.col("callers"), F.lit(" callers")).alias("detail"))


def merged(overlay: DataFrame, base: DataFrame, key: str = "uid") -> DataFrame:
    """Overlay rows, then the base rows whose key it lacks."""
    return overlay.unionByName(base.join(overlay.select(key).distinct(), key, "left_anti"))


def promoted(overlay: DataFrame, new_base: DataFrame, diverged: bool = False) -> DataFrame:
    """Overlay entries (path, hash) that a base moved forward does not hold yet; a file that is missing there stays.

    Where the new base does not come from the old one, the session starts afresh and its entries are set aside.
    """
    if diverged:
        return overlay.limit(0)
    return overlay.join(new_base.select("path", F.col("hash").alias("base_hash")), "path", "left").where("base_hash IS NULL OR base_hash <> hash").drop("base_hash")


def incremental(old: DataFrame, new: DataFrame, file_facts: DataFrame) -> DataFrame:
    """(uid, action): whether a symbol (uid, file_id, content_hash) must be resolved again.

    ``file_facts``: (file_id, schema_changed, touched, imports_changed); they decide first, in this order.
    """
    before = old.select("uid", F.col("content_hash").alias("before"))
    facts = new.join(before, "uid", "left").join(file_facts, "file_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    same = (F.col("content_hash") == F.col("before")) & (F.col("content_hash") != 0)
    action = F.when(yes("schema_changed"), "resolve").when(~yes("touched"), "keep").when(yes("imports_changed"), "resolve").when(F.coalesce(same, F.lit(False)), "keep").otherwise("resolve")
    return facts.select("uid", action.alias("action"))


def shadowed(changed: DataFrame, files_: DataFrame) -> DataFrame:
    """(path, shadows): files from which a changed script takes over imports: same stem with another ending, or the index of a folder of that name."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(ts|tsx|js|jsx|mjs|cjs)$", ""), r"/index$", "")
    scripts = r"\.(ts|tsx|js|jsx|mjs|cjs)$"
    a = changed.where(F.col("path").rlike(scripts)).select("path", stem(F.col("path")).alias("stem"))
    b = files_.where(F.col("path").rlike(scripts)).select(F.col("path").alias("shadows"), stem(F.col("path")).alias("stem"))
    return a.join(b, "stem").where("path <> shadows").select("path", "shadows")


def latest(snapshots: DataFrame, keep: int) -> DataFrame:
    """Snapshots (repo, built_no) that stay, the newest of each repository."""
    return snapshots.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("built_no")))).where(F.col("r") <= keep).drop("r")
