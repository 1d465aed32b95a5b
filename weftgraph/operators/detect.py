"""Pattern detectors and summaries over a graph."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import glob_pattern, literal_likeness
from weftgraph.operators.traverse import reach


def summary(nodes: DataFrame) -> DataFrame:
    """Numbers of nodes by kind."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def metrics(graph, symbols: tuple[str, ...] = ("Function", "Method", "Class", "Interface")) -> DataFrame:
    """One row (nodes, edges, files, symbols) of the sizes of a snapshot."""
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind").isin(*symbols)).alias("symbols"))
    sizes = graph.edges.agg(F.count(F.lit(1)).alias("edges")), graph.side("files").agg(F.count(F.lit(1)).alias("files"))
    # Three tables of one row each.
    return nodes.crossJoin(sizes[0]).crossJoin(sizes[1]).select("nodes", "edges", "files", "symbols")


def tier(confidence: Column, strong: float) -> Column:
    return F.when(confidence >= strong, "strong").otherwise("weak")


def schema_bindings(nodes: DataFrame, edges: DataFrame, strong: float = 0.85) -> DataFrame:
    """(field, mirror, confidence, tier) of mirrored fields, each pair once."""
    pairs = edges.where(F.col("rel_type") == "MirrorsField").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    names = lambda c, n: nodes.select(F.col("id").alias(c), F.col("name").alias(n))
    return pairs.join(names("src", "field"), "src").join(names("dst", "mirror"), "dst").select("src", "dst", "field", "mirror", "confidence", tier(F.col("confidence"), strong).alias("tier"))


def unmirrored(fields: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of fields that occur at least twice without any mirror edge."""
    tied = edges.where(F.col("rel_type") == "MirrorsField").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    held = fields.join(tied.withColumn("tied", F.lit(1)), "id", "left").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("tied").alias("tied"))
    return held.where("n >= 2 AND tied = 0").select("name", "n")


def event_mirrors(nodes: DataFrame, edges: DataFrame, glob: str = "**", min_confidence: float = 0.0) -> DataFrame:
    """(topic, mirror, publisher, subscriber, confidence): topics with their mirrors, and the first publisher and subscriber."""
    name = nodes.select("id", "name")
    first = lambda rel, n: edges.where(F.col("rel_type") == rel).groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "edge_id").alias(n))
    topics = name.where(F.col("name").rlike(glob_pattern(glob)))
    mirrors = edges.where((F.col("rel_type") == "EventTopicMirror") & (F.col("confidence") >= min_confidence))
    out = mirrors.join(topics.select(F.col("id").alias("src"), F.col("name").alias("topic")), "src").join(name.select(F.col("id").alias("dst"), F.col("name").alias("mirror")), "dst")
    out = out.join(first("Publishes", "publisher").withColumnRenamed("id", "src"), "src", "left").join(first("Subscribes", "subscriber").withColumnRenamed("id", "dst"), "dst", "left")
    return out.select("topic", "mirror", "publisher", "subscriber", "confidence")


def saga_list(nodes: DataFrame, edges: DataFrame, owner: str | None = None, strong: float = 0.75) -> DataFrame:
    """(action, compensation, confidence, tier) of compensated actions."""
    name = lambda c, n: nodes.select(F.col("id").alias(c), F.col("name").alias(n), F.col("owner_class").alias(f"{n}_owner"))
    out = edges.where(F.col("rel_type") == "CompensatedBy").join(name("src", "action"), "src").join(name("dst", "compensation"), "dst")
    out = out.where(F.col("action_owner") == owner) if owner else out
    return out.select("action", "compensation", "confidence", tier(F.col("confidence"), strong).alias("tier"))


def outbox(nodes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(table_id, writer_id, publisher_id, confidence): writers of outbox tables from which a publishing call is reached."""
    tables = nodes.where(F.lower("name").rlike("^(outbox_?event|event_?outbox|message_?outbox)(s|es)?$")).select(F.col("id").alias("table_id"), F.col("name").alias("table"))
    methods = nodes.join(tables, F.col("owner_class") == F.col("table")).select("table_id", F.col("id").alias("writer_id"), F.lit(0.80).alias("confidence"))
    touching = edges.where(F.col("rel_type") == "References").join(tables, F.col("dst") == F.col("table_id")).select("table_id", F.col("src").alias("writer_id"), F.lit(0.75).alias("confidence"))
    writers = methods.unionByName(touching).groupBy("table_id", "writer_id").agg(F.max("confidence").alias("confidence"))
    reached = reach(writers.select(F.col("writer_id").alias("seed")), edges.where(F.col("rel_type") == "Calls"), "out", depth)
    publishes = edges.where(F.col("rel_type") == "Publishes").select(F.col("src").alias("node")).distinct()
    return writers.join(reached.join(publishes, "node", "left_semi").select(F.col("seed").alias("writer_id"), F.col("node").alias("publisher_id")), "writer_id").select("table_id", "writer_id", "publisher_id", "confidence")


def frameworks(edges: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Numbers of edges by framework; a rule that ends in ``*`` is a prefix of the reason."""
    match = None
    for pattern, name in rules.items():
        hit = F.col("reason").startswith(pattern[:-1]) if pattern.endswith("*") else F.col("reason") == pattern
        match = F.when(hit, name) if match is None else match.when(hit, name)
    return edges.select(match.alias("framework")).where(F.col("framework").isNotNull()).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))


def blind_spots(spots: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Numbers by kind, without those that only measure parsers."""
    return (spots.where(~F.col("kind").isin(list(metrics))) if metrics else spots).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def uid_collisions(nodes: DataFrame) -> DataFrame:
    """(uid, kind, n, cause) of uids that several nodes share."""
    shared = nodes.groupBy("uid", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("start_row").alias("rows"), F.first("owner_class", ignorenulls=True).alias("owner")).where("n > 1")
    callable_ = F.col("kind").isin("Function", "Method", "Constructor")
    cause = F.when(callable_ & F.col("owner").isNotNull(), "method-overload").when(callable_, "ifdef-redef").when(F.col("kind").isin("Property", "Variable", "Const"), "field-reassign").otherwise("uid-collision")
    return shared.select("uid", "kind", "n", cause.alias("cause"))


def audit(spots: DataFrame, k: int) -> DataFrame:
    """The k commonest clusters of hints (language, cause), with their share of all."""
    parts = F.split("hint", ":")
    counts = spots.select(F.get(parts, 0).alias("language"), F.coalesce(F.get(parts, 1), F.lit("")).alias("cause")).groupBy("language", "cause").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("language", "cause", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "language", "cause").limit(k)


# Tiers of a resolver, best first, and what is stripped from the end of a path before it is compared.
TIERS = "SameFile ImportScoped Global AmbiguousGlobal".split()
ENDINGS = {
    "typescript": [".d.ts .tsx .jsx .mjs .cjs .ts .js".split(), ["/index", "/main"]],
    "python": [[".pyi", ".py"], ["/__init__"]],
    "rust": [[".rs"], ["/mod", "/lib", "/main"]],
}


def module_path(path: Column, language: str = "") -> Column:
    """A path without that by which paths of one module differ."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.regexp_replace(out, r"^(\./)+", "") if language == "typescript" else out
    for ends in ENDINGS.get(language, []):
        out = F.regexp_replace(out, "(" + "|".join(re.escape(e) for e in ends) + ")$", "")
    return out


def verify(expected: DataFrame, decided: DataFrame, language: str = "") -> DataFrame:
    """(tier, verdict, n) of decisions (key, target, tier, alt_count) against what is expected (key, target).

    The best tier of a key counts, of equal ones the least target. TP: the same module, counted as ``demoted`` too where
    the tier is Global and as ``FP_overmatch`` where there were other candidates; FP_ghost: another module, or one where
    none is expected; FN: none where one is; ``expected_only`` and ``decided_*``: keys of one side alone.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    best = decided.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "target", "alt_count", "tier")).alias("d"))
    both = expected.select("key", "target", F.lit(True).alias("known")).join(best, "key", "full_outer")
    ours, theirs = module_path(F.col("d.target"), language), module_path(F.col("target"), language)
    hit = F.array_compact(F.array(F.lit("TP"), F.when(F.col("d.tier") == "Global", "demoted"), F.when(F.col("d.alt_count") > 0, "FP_overmatch")))
    verdict = (
        F.when(F.col("known").isNull(), F.array(F.when(F.col("d.tier") == "SameFile", "decided_same_file").otherwise("decided_other")))
        .when(F.col("d").isNull(), F.array(F.lit("expected_only"))).when(ours == theirs, hit).when(ours.isNotNull(), F.array(F.lit("FP_ghost"))).when(theirs.isNotNull(), F.array(F.lit("FN")))
    )
    return both.select("d.tier", F.explode(verdict).alias("verdict")).groupBy("tier", "verdict").agg(F.count(F.lit(1)).alias("n"))


def literal_pairs(literals: DataFrame, least: float = 0.85) -> DataFrame:
    """Literals (literal, directory, extension, access) that only read and others that only write, alike within a directory and extension.

    Two literals are compared if their lengths allow so few edits, or if the longest word of the shorter is a word of the
    longer, as it is wherever one sits in the other at a boundary; no other pair can be alike.
    """
    groups = literals.groupBy("literal", "directory", "extension").agg(F.bool_or(F.col("access") == "read").alias("r"), F.bool_or(F.col("access") == "write").alias("w"))
    place = ["directory", "extension"]
    reads = groups.where("r AND NOT w").select(*place, F.col("literal").alias("read"))
    writes = groups.where("w AND NOT r").select(*place, F.col("literal").alias("written"))
    size = F.length("read")
    lengths = F.sequence(F.ceil(size * least - 1e-9).cast("int"), F.floor(size / least + 1e-9).cast("int"))
    near = reads.withColumn("length", F.explode(lengths)).join(writes.withColumn("length", F.length("written")), [*place, "length"]).select(*place, "read", "written")
    words = lambda c: F.array_distinct(F.split(F.col(c), "[^A-Za-z0-9]+"))
    # A literal without words has the empty one, which every literal is given.
    every = lambda df, c: df.withColumn("word", F.explode(F.array_union(words(c), F.array(F.lit("")))))
    longest = lambda df, c: df.where(F.length(c) >= 4).withColumn("word", F.array_max(F.transform(words(c), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    parts = [longest(reads, "read").join(every(writes, "written"), [*place, "word"]), every(reads, "read").join(longest(writes, "written"), [*place, "word"])]
    pairs = reduce(DataFrame.unionByName, [near, *(p.select(*place, "read", "written") for p in parts)]).distinct()
    return pairs.withColumn("likeness", literal_likeness(F.col("read"), F.col("written"))).where(F.col("likeness") >= least)


def rename_targets(nodes: DataFrame, target: str) -> DataFrame:
    """Nodes in files that ``Owner.name`` names, or a bare name of symbols without an owner."""
    owner, _, name = target.rpartition(".")
    held = F.coalesce("owner_class", F.lit("")) == owner
    return nodes.where(F.col("file_id").isNotNull() & (F.col("name") == name) & held)


def rename_files(graph, targets: DataFrame) -> DataFrame:
    """(file_id, edges): the files of the targets and of all that refer to them by a sure edge, with the number of such edges."""
    ids = targets.select(F.col("id").alias("dst"))
    sure = graph.edges.where(~F.col("rel_type").isin(sorted(graph.profile.heuristic))).join(ids, "dst", "left_semi")
    users = sure.select("src").join(graph.nodes.where("file_id IS NOT NULL").select(F.col("id").alias("src"), "file_id"), "src").select("file_id", F.lit(1).alias("e"))
    return users.unionByName(targets.select("file_id", F.lit(0).alias("e"))).groupBy("file_id").agg(F.sum("e").alias("edges"))


def rename_guesses(graph, targets: DataFrame) -> DataFrame:
    """(name, n): heuristic edges into and out of the targets by the name at the other end; they are counted, not followed."""
    guess = graph.edges.where(F.col("rel_type").isin(sorted(graph.profile.heuristic)))
    ids, ends = targets.select("id"), []
    for own, other in (("dst", "src"), ("src", "dst")):
        ends.append(guess.join(ids.withColumnRenamed("id", own), own, "left_semi").select(F.col(other).alias("id")))
    return ends[0].unionByName(ends[1]).join(graph.nodes.select("id", "name"), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def rename_collisions(graph, new_name: str) -> DataFrame:
    """(id, file_id, start_row) of nodes that have the new name already."""
    return graph.nodes.where(F.col("name") == new_name).select("id", "file_id", "start_row")


def mentions(lines: DataFrame, name: str) -> DataFrame:
    """Lines (file_id, path, line, text) with the whole word; the path says whether this is a test, markdown, data or code."""
    word = rf"(?U)\b\Q{name}\E\b"
    test = F.col("path").contains("/test/") | F.col("path").contains("/tests/") | F.col("path").rlike(r"_test\.(go|rs)$")
    context = F.when(test, "test").when(F.col("path").rlike(r"\.(md|rst|markdown)$"), "markdown").when(F.col("path").rlike(r"\.(json|toml|yaml|yml)$"), "data").otherwise("code")
    return lines.where(F.col("text").rlike(word)).withColumn("context", context)


def risk(changes: DataFrame, key: str) -> DataFrame:
    """(key, touched, risk): low up to 5 touched symbols, medium up to 30, high beyond."""
    return changes.groupBy(key).agg(F.count(F.lit(1)).alias("touched")).withColumn("risk", F.when(F.col("touched") <= 5, "low").when(F.col("touched") <= 30, "medium").otherwise("high"))


def areas(changes: DataFrame, key: str, path: str, rules: dict[str, str]) -> DataFrame:
    """(key, area): the area on which all paths of a change agree, by the first pattern that fits each; null where they do not, or one fits none."""
    area = F.lit(None).cast("string")
    for pattern, name in reversed(rules.items()):
        area = F.when(F.col(path).rlike(pattern), name).otherwise(area)
    agreed = changes.select(F.col(key), area.alias("area")).groupBy(key).agg(F.min("area").alias("a"), F.max("area").alias("b"), F.bool_or(F.col("area").isNull()).alias("none"))
    return agreed.select(key, F.when((F.col("a") == F.col("b")) & ~F.col("none"), F.col("a")).alias("area"))


def conflicts(changes: DataFrame, key: str, symbol: str) -> DataFrame:
    """(a, b, common): pairs of change sets that touch the same symbols, counted through the symbols.

    Names of anonymous symbols hold a line number, so that they say nothing of another change and are left out.
    """
    x = changes.where(~F.col(symbol).cast("string").startswith("<anonymous:")).select(F.col(key).alias("a"), symbol).distinct()
    return x.join(x.withColumnRenamed("a", "b"), symbol).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def neighbours(graph, kinds: tuple[str, ...] = (), relations: tuple[str, ...] = (), file_part: str = "", tests: bool = True) -> DataFrame:
    """(id, direction, rel_type, heuristic, near, name, kind, file_path): every edge seen from both ends, less what the filters on the other end leave out."""
    view = graph.node_view({"file_path", "category"} if file_part or not tests or graph.files is not None else {"id"})
    if kinds:
        view = view.where(F.lower("kind").isin([k.lower() for k in kinds]))
    if file_part:
        view = view.where(F.contains("file_path", F.lit(file_part)))
    if not tests:
        view = view.where(F.coalesce(F.col("category") != "Test", F.lit(True)))
    edges = graph.edges.where(F.col("rel_type").isin(*relations)) if relations else graph.edges
    guess = F.col("rel_type").isin(sorted(graph.profile.heuristic))
    sides = [edges.select(F.col(own).alias("id"), F.col(other).alias("near"), "rel_type", guess.alias("heuristic"), F.lit(way).alias("direction")) for own, other, way in (("src", "dst", "out"), ("dst", "src", "in"))]
    place = F.col("file_path") if "file_path" in view.columns else F.lit(None).cast("string")
    return reduce(DataFrame.unionByName, sides).join(view.select(F.col("id").alias("near"), "name", "kind", "file_id", place.alias("file_path")), "near")


def upstream(near: DataFrame) -> DataFrame:
    """(id, near, name, kind, file_path): the nodes right upstream of each, once each, of those that ``neighbours`` gives; files and nodes without a file are left out, and so is a node itself."""
    into = near.where("direction = 'in' AND kind <> 'File' AND file_id IS NOT NULL AND near <> id")
    return into.select("id", "near", "name", "kind", "file_path").distinct()


def inspect(graph) -> DataFrame:
    """(id, direction, rel_type, n, first): neighbours of every node by direction and relation, the first three by name."""
    name = graph.nodes.select("id", "name")
    sides = [graph.edges.select(F.col(own).alias("id"), F.col(other).alias("near"), "rel_type", F.lit(way).alias("direction")) for own, other, way in (("src", "dst", "out"), ("dst", "src", "in"))]
    near = reduce(DataFrame.unionByName, sides).join(name.select(F.col("id").alias("near"), "name"), "near")
    by = ["id", "direction", "rel_type"]
    counts = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # The filter on the rank lets each task pass on three rows of a group at most.
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("name", "near"))).where("r <= 3")
    first = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("f"))
    return counts.join(first, by).select(*by, "n", F.transform("f", lambda x: x["name"]).alias("first"))


def without_impls(nodes: DataFrame) -> DataFrame:
    """Nodes, less Impl where a type of the same name is there; ``suppressed`` counts what went."""
    types = F.col("kind").isin("Class", "Interface", "Struct", "Enum", "Typedef", "Trait")
    known = nodes.groupBy("name").agg(F.bool_or(types).alias("typed"), F.count_if(F.col("kind") == "Impl").alias("impls"))
    return nodes.join(known, "name").where(~(F.col("typed") & (F.col("kind") == "Impl"))).withColumn("suppressed", F.when(F.col("typed"), F.col("impls")).otherwise(0)).drop("typed", "impls")


def overlapping(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans (file_id, id, start_row, end_row) that meet a range (file_id, low, high) of lines of their file."""
    return spans.join(ranges, "file_id").where((F.col("start_row") <= F.col("high")) & (F.col("end_row") >= F.col("low")))


def enclosing(spans: DataFrame, places: DataFrame) -> DataFrame:
    """(place_id, id): the innermost scope around each place (file_id, place_id, line); the first wins ties.

    Scopes are spans (file_id, id, kind, name, start_row, end_row) of named functions, methods, constructors, classes and
    constants of several lines.
    """
    scope = F.col("kind").isin("Function", "Method", "Constructor", "Class") | ((F.col("kind") == "Const") & (F.col("end_row") > F.col("start_row")))
    scopes = spans.where(scope & ~F.col("name").startswith("<anonymous")).select("file_id", "id", "start_row", "end_row")
    inside = scopes.join(places.select("file_id", "place_id", "line"), "file_id").where((F.col("start_row") <= F.col("line")) & (F.col("end_row") >= F.col("line")))
    return inside.groupBy("place_id").agg(F.min_by("id", F.struct(F.col("end_row") - F.col("start_row"), "id")).alias("id"))


def members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, bucket, n): methods, properties and variants of each owner."""
    bucket = F.when(F.col("rel_type") == "HasMethod", "methods").when(F.col("rel_type") == "HasProperty", "properties").when((F.col("rel_type") == "Defines") & (F.col("kind") == "EnumVariant"), "variants")
    return edges.join(nodes.select(F.col("id").alias("dst"), "kind"), "dst").select(F.col("src").alias("id"), bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def file_by_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """The first file whose path ends so."""
    return files.where(F.col("path").endswith(suffix)).orderBy("path").limit(1)
