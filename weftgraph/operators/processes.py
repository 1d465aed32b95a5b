"""Entry points, process traces, communities and modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scratch import cut


def entry_points(nodes: DataFrame, edges: DataFrame, top: int = 200, min_confidence: float = 0.5) -> DataFrame:
    """(id, callees, callers, score) of the nodes that call much and are called little; parallel edges count, loops do not."""
    flow = edges.where((F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst")))
    out = flow.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    into = flow.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    scored = nodes.where(~F.col("is_test")).select("id").join(out, "id").join(into, "id", "left").select("id", "callees", F.coalesce("callers", F.lit(0)).alias("callers"))
    return scored.withColumn("score", F.col("callees") / (1 + F.col("callers"))).orderBy(F.desc("score"), "id").limit(top)


def traces(entries: DataFrame, edges: DataFrame, fan: int = 4, longest: int = 10, per_entry: int = 12, shortest: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """(entry, steps): paths along the first callees of each node, without cycles, at most so many of each entry."""
    flow = edges.where((F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst"))).select("src", "dst", "edge_id")
    first = flow.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("edge_id", "dst"))).where(F.col("r") <= fan)
    first = cut(first.select("src", "dst", "r"), "callees")
    paths = cut(entries.select(F.col("id").alias("entry"), F.array("id").alias("steps"), F.array().cast("array<int>").alias("turn")), "paths")
    ended = []
    for size in range(1, longest + 1):
        if size == longest:
            ended.append(paths)
            break
        last = paths.withColumn("src", F.element_at("steps", -1))
        grown = last.join(first, "src").where(~F.array_contains("steps", F.col("dst"))).select("entry", F.concat("steps", F.array("dst")).alias("steps"), F.concat("turn", F.array("r")).alias("turn"))
        grown = cut(grown, "paths")
        done = last.join(grown.select("entry", F.slice("steps", 1, size).alias("steps")).distinct(), ["entry", "steps"], "left_anti").drop("src")
        ended.append(done)
        if grown.isEmpty():
            break
        # Later traces are longer, so an entry whose quota is full needs no more of its open paths.
        full = _union(ended).where(F.size("steps") >= shortest).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_entry)
        paths = cut(grown.join(full, "entry", "left_anti"), "paths")
    out = _union(ended)
    out = out.where(F.size("steps") >= shortest)
    return out.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy(F.size("steps"), "turn"))).where(F.col("k") <= per_entry).select("entry", "steps")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_traces(found: DataFrame, top: int = 75) -> DataFrame:
    """(entry, terminal, steps): contiguous parts of longer traces go, one trace of each pair of ends stays, the longest first."""
    parts = found.select("steps", F.explode(F.expr("flatten(transform(sequence(1, size(steps)), i -> transform(sequence(1, size(steps) - i + 1), n -> slice(steps, i, n))))")).alias("part")).where(F.size("part") < F.size("steps"))
    whole = found.join(parts.select(F.col("part").alias("steps")).distinct(), "steps", "left_anti")
    ends = whole.withColumn("terminal", F.element_at("steps", -1)).groupBy("entry", "terminal").agg(F.min_by("steps", F.struct(-F.size("steps"), "steps")).alias("steps"))
    return ends.orderBy(F.desc(F.size("steps")), "steps").limit(top)


def process_type(found: DataFrame, communities: DataFrame) -> DataFrame:
    """(entry, terminal, steps, process_type): cross if the steps lie in several communities other than 0."""
    steps = found.select("entry", "terminal", "steps", F.explode("steps").alias("id")).join(communities, "id", "left")
    kinds = F.count_distinct(F.when(F.col("community_id") != 0, F.col("community_id")))
    return steps.groupBy("entry", "terminal", "steps").agg(kinds.alias("n")).select("entry", "terminal", "steps", F.when(F.col("n") > 1, "cross").otherwise("intra").alias("process_type"))


def step_edges(processes: DataFrame) -> DataFrame:
    """Edges from members to processes, reason ``step:n``."""
    return processes.select(F.posexplode("steps").alias("p", "src"), F.col("process_id").alias("dst")).select("src", "dst", F.lit("StepInProcess").alias("rel_type"), F.lit(1.0).cast("float").alias("confidence"), F.concat(F.lit("step:"), F.col("p") + 1).alias("reason"))


def process_nodes(processes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(process_id, label): a node for each process, labelled by the names of its ends, ``Entry → Terminal``."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    ends = processes.select("process_id", F.element_at("steps", 1).alias("entry"), F.element_at("steps", -1).alias("terminal"))
    return ends.join(name("entry"), "entry").join(name("terminal"), "terminal").select("process_id", F.concat("entry_name", F.lit(" → "), "terminal_name").alias("label"))


def listed(processes: DataFrame, community: int | None = None, label: str | None = None, limit: int | None = 50) -> DataFrame:
    """(process_id, label, process_type, n_steps) of the processes of a community, with a piece of the label in any case; the longest first."""
    found = processes if community is None else processes.where(F.array_contains("communities", community))
    found = found if label is None else found.where(F.lower("label").contains(label.lower()))
    found = found.select("process_id", "label", "process_type", F.size("steps").alias("n_steps")).orderBy(F.desc("n_steps"), "process_id")
    return found if limit is None else found.limit(limit)


def traced(processes: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(process_id, step, id, name): the steps, from 1, of the processes with a piece of the label."""
    steps = processes.where(F.lower("label").contains(label.lower())).select("process_id", F.posexplode("steps").alias("p", "id"))
    return steps.join(nodes.select("id", "name"), "id").select("process_id", (F.col("p") + 1).alias("step"), "id", "name")


def processes_containing(processes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(process_id, id, step): the first place of each node in each process, from 1."""
    steps = processes.select("process_id", F.posexplode("steps").alias("p", "id"))
    return steps.join(nodes.select("id"), "id", "left_semi").groupBy("process_id", "id").agg((F.min("p") + 1).alias("step"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (q): the sum over communities of inner weight / m - (degree / 2m) squared, edges undirected."""
    e = edges.select("src", "dst", F.col("confidence").cast("double").alias("w"))
    c = communities.select("id", "community_id")
    placed = e.join(c.select(F.col("id").alias("src"), F.col("community_id").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community_id").alias("b")), "dst")
    ends = placed.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("w").alias("deg"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("inner")), F.struct(F.col("b").alias("c"), F.col("w").alias("deg"), F.lit(0.0).alias("inner")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("deg").alias("deg"), F.sum("inner").alias("inner"))
    # Degrees sum to 2m, so m comes from the same table.
    return sums.agg(F.sum("inner").alias("inner"), F.sum(F.col("deg") * F.col("deg")).alias("squares"), F.sum("deg").alias("d")).select((F.col("inner") / (F.col("d") / 2) - F.col("squares") / (F.col("d") * F.col("d"))).alias("q"))


#: Nodes beyond which a graph loses its unsure edges and loose ends before communities are sought.
LARGE = 10_000


def thinned(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A large graph without edges below ``min_confidence`` and nodes of one edge; a small one as it is."""
    if nodes.limit(LARGE + 1).count() <= LARGE:
        return nodes, edges
    sure = cut(edges.where(F.col("confidence") >= min_confidence), "sure")
    ends = sure.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = cut(nodes.join(ends.select("id"), "id", "left_semi"), "kept")
    inside = sure.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inside


def split(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, part): the connected parts of each community (id, c), named by their smallest id; ``links`` (a, b) go both ways.

    Each round takes the least name of the neighbours, then the name of that name, so long chains shorten by halves.
    """
    ends = links.select("a", "b").join(placed.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(placed.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    inside = cut(ends.where("ca = cb").select("a", "b"), "inside")
    parts = cut(placed.select("id", F.col("id").alias("part")), "parts")
    while True:
        near = inside.join(parts.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        least = parts.join(near, "id", "left").select("id", "part", F.least("part", F.coalesce("near", "part")).alias("least"))
        further = least.join(parts.select(F.col("id").alias("least"), F.col("part").alias("hop")), "least").select("id", "part", F.least("least", "hop").alias("next"))
        following = cut(further, "parts")
        if following.where("next <> part").isEmpty():
            return following.select("id", F.col("next").alias("part"))
        parts = following.select("id", F.col("next").alias("part"))


def communities(nodes: DataFrame, edges: DataFrame, passes: int = 3, rounds: int = 64, min_gain: float = 1e-7) -> DataFrame:
    """(id, community_id) by local moves for modularity, refinement and aggregation, a few passes.

    Moves are synchronous: in each round half of the nodes, by a hash of the round, go to the neighbouring community
    of most gain, until no node moves. Then each community is split into its connected parts, which are the nodes of the
    next pass, with the weights summed between them; so every community is connected.
    """
    both = edges.where(F.col("src") != F.col("dst")).select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x"), F.col("confidence").cast("double").alias("w")).select("x.a", "x.b", "w")
    links = cut(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    degree = cut(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    two_m = degree.agg(F.sum("k").alias("m")).first()["m"] or 1.0
    placed = cut(nodes.select("id", F.col("id").alias("community_id")), "communities")
    for turn in range(passes):
        super_links = links.join(placed.select(F.col("id").alias("a"), F.col("community_id").alias("ca")), "a").join(placed.select(F.col("id").alias("b"), F.col("community_id").alias("cb")), "b")
        level = cut(super_links.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")).where("a <> b"), "level")
        k = cut(degree.join(placed, "id").groupBy(F.col("community_id").alias("id")).agg(F.sum("k").alias("k")), "level-degrees")
        now = cut(k.select("id", F.col("id").alias("c")), "moves")
        moved, still = False, 0
        for step in range(rounds):
            mass = now.join(k, "id").groupBy("c").agg(F.sum("k").alias("mass"))
            to = level.join(now.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
            own = now.withColumnRenamed("c", "own").join(k, "id")
            choice = own.join(to, "id").join(mass, "c").withColumn("gain", F.col("w") - F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / two_m)
            best = choice.groupBy("id").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("best"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            stay = own.join(mass.withColumnRenamed("c", "own"), "own").select("id", "own", (-F.col("k") * (F.col("mass") - F.col("k")) / two_m).alias("alone"))
            turn_of = F.pmod(F.xxhash64("id", F.lit(turn * 100 + step)), F.lit(2)) == 0
            goes = turn_of & (F.col("gain") > F.coalesce(F.col("stay"), F.col("alone")) + min_gain)
            following = cut(stay.join(best, "id", "left").select("id", F.when(goes, F.col("best")).otherwise(F.col("own")).alias("c"), F.coalesce(goes, F.lit(False)).alias("moved")), "moves")
            changed = not following.where("moved").isEmpty()
            moved, now = moved or changed, following.select("id", "c")
            still = 0 if changed else still + 1
            if still == 4:  # each node had its turn, but for one in sixteen
                break
        if not moved:
            break
        now = split(level, now).withColumnRenamed("part", "c")
        placed = cut(placed.join(now.select(F.col("id").alias("community_id"), "c"), "community_id", "left").select("id", F.coalesce("c", "community_id").alias("community_id")), "communities")
    return placed
