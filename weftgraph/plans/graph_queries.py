"""Registered queries of the graph, search, diff, derivation and telemetry operators, each with SQL for the same rows.

The driver's tables play the parts: see the README for which table stands for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import derive, detect, diff, processes, routes, search, telemetry, traverse
from weftgraph.sources import commerce
from weftgraph.sources.commerce import STEP, table
from weftgraph.streaming import inbox

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False):
    """Register a function as a query of its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {commerce.SQL}{sql}" if graph else sql
        return f

    return add


# --- traversal

_INSIDE = "rel_type IN ('IN_REGION', 'IN_NATION')"


@query(f""", walk AS (
  SELECT id AS seed, id AS node, 0 AS depth FROM nodes WHERE kind = 'Region'
  UNION SELECT w.seed, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node AND {_INSIDE} WHERE w.depth < 5)
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node""", graph=True)
def reach_from_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'Region'").select(F.col("id").alias("seed"))
    return traverse.reach(seeds, g.edges.where(_INSIDE), "in").select("seed", "node", "depth")


@query(f"""SELECT {2 * STEP + 3} AS node, 0 AS depth UNION ALL SELECT {3 * STEP} + c_custkey, 1 FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT {4 * STEP} + s_suppkey, 1 FROM supplier WHERE s_nationkey = 3""")
def callers_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.callers_of(commerce.graph(spark, sf_dir), 2 * STEP + 3, 1, limit=None)


@query(f"""SELECT {2 * STEP + 3} AS node, 0 AS depth UNION ALL SELECT {STEP} + n_regionkey, 1 FROM nation WHERE n_nationkey = 3""")
def callees_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.callees_of(commerce.graph(spark, sf_dir), 2 * STEP + 3, 3)


@query(f""", walk AS (
  SELECT {4 * STEP + 7} AS node, 0 AS depth, NULL::VARCHAR AS rel_type
  UNION SELECT e.src, w.depth + 1, e.rel_type FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 3 AND e.confidence >= 0.5 AND NOT e.{_INSIDE})
SELECT node, min(depth) AS depth, min(rel_type) AS rel_type, CASE WHEN min(rel_type) = 'SUPPLIED_BY' THEN 'heuristic' ELSE 'deterministic' END AS bucket
FROM walk WHERE depth > 0 GROUP BY node""", graph=True)
def impact_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    seeds = traverse.resolve_targets(g, "Supplier#000000007").select(F.col("id").alias("seed"))
    return traverse.impact(g, seeds, "up", 3, 0.5).select("node", "depth", "rel_type", "bucket")


@query(f""", walk AS (
  SELECT {3 * STEP + 5} AS node, 0 AS depth
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 4 AND e.confidence >= 0.95 AND e.rel_type NOT IN ('IN_REGION', 'IN_NATION', 'SUPPLIED_BY'))
SELECT node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY node""", graph=True)
def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    seeds = traverse.resolve_targets(g, "Customer#000000005").select(F.col("id").alias("seed"))
    return traverse.impact(g, seeds, "down", 4, 0.95, heuristic=False).select("node", "depth")


@query("""SELECT id AS seed, count(*) FILTER (confidence < 0.95) AS low_confidence, count(*) FILTER (confidence >= 0.95 AND rel_type = 'SUPPLIED_BY') AS heuristic
FROM (SELECT n.id, e.* FROM nodes n JOIN edges e ON e.src = n.id UNION ALL SELECT n.id, e.* FROM nodes n JOIN edges e ON e.dst = n.id) WHERE id BETWEEN 5000000000000000 AND 5999999999999999 GROUP BY id""".replace("SELECT id", " SELECT id", 1), graph=True)
def impact_hidden_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    parts = g.nodes.where("kind = 'Part'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return traverse.hidden_edges(g, parts, "both", 0.95)


@query(""", calls AS (SELECT DISTINCT e.dst AS seed, o.id, o.amount > 250000 AS t FROM edges e JOIN nodes o ON o.id = e.src WHERE e.rel_type = 'CONTAINS'),
n AS (SELECT p.id AS seed, count(c.id) FILTER (NOT c.t) AS production, count(c.id) FILTER (c.t) AS tests FROM nodes p LEFT JOIN calls c ON c.seed = p.id WHERE p.kind = 'Part' GROUP BY p.id)
SELECT seed, production, tests, CASE WHEN production = 0 AND tests = 0 THEN 'Orphan' WHEN tests = 0 THEN 'Uncovered' WHEN production > 3 * tests THEN 'Partial' ELSE 'Covered' END AS coverage FROM n""", graph=True)
def coverage_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    seeds = g.nodes.where("kind = 'Part'").select(F.col("id").alias("seed"))
    return traverse.coverage(traverse.impact(g, seeds, "up", 1), g.nodes.select("id", (F.col("amount") > 250000).alias("is_test")), seeds)


@query(""", near AS (
  SELECT e.src AS id, 'out' AS direction, e.rel_type, n.name, n.id AS near FROM edges e JOIN nodes n ON n.id = e.dst
  UNION ALL SELECT e.dst, 'in', e.rel_type, n.name, n.id FROM edges e JOIN nodes n ON n.id = e.src)
SELECT id, direction, rel_type, count(*) AS n, (list(name ORDER BY name, near))[1:3] AS first FROM near GROUP BY id, direction, rel_type""", graph=True)
def inspect_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.inspect(commerce.graph(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a span of lines of its file."""
    kind = F.expr("CASE role WHEN 'user' THEN 'Function' WHEN 'assistant' THEN 'Const' ELSE 'Property' END")
    name = F.concat(F.when(F.col("turn") % 5 == 2, "<anonymous:").otherwise("f"), "turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), kind.alias("kind"), name.alias("name"), F.col("turn").alias("start_row"), (F.col("turn") + F.length("text") % 4).alias("end_row"))


_SPANS = "SELECT conv_id AS file_id, conv_id * 1000 + turn AS id, role, turn, turn AS a, turn + length(text) % 4 AS b FROM conversations"


@query(f"SELECT s.id, s.file_id FROM ({_SPANS}) s WHERE a <= 4 AND b >= 3")
def nodes_overlapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    ranges = spans.select("file_id").distinct().select("file_id", F.lit(3).alias("low"), F.lit(4).alias("high"))
    return detect.overlapping(spans, ranges).select("id", "file_id")


@query(f"""SELECT place_id, arg_min(id, struct_pack(w := b - a, i := id)) AS id FROM ({_SPANS}) s JOIN (SELECT conv_id, conv_id * 1000 + turn AS place_id, turn AS line FROM conversations) p ON p.conv_id = s.file_id AND a <= line AND b >= line WHERE turn % 5 <> 2 AND (role = 'user' OR (role = 'assistant' AND b > a)) GROUP BY place_id""")
def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    return detect.enclosing(spans, spans.select("file_id", F.col("id").alias("place_id"), F.col("start_row").alias("line")))


# --- algorithms


@query(""", c AS (SELECT id, id % 7 AS c FROM nodes),
p AS (SELECT e.confidence AS w, a.c AS a, b.c AS b FROM edges e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst),
s AS (SELECT c, sum(deg) AS deg, sum(inn) AS inn FROM (SELECT a AS c, w AS deg, CASE WHEN a = b THEN w ELSE 0 END AS inn FROM p UNION ALL SELECT b, w, 0 FROM p) GROUP BY c)
SELECT round(sum(inn) / (sum(deg) / 2) - sum(deg * deg) / (sum(deg) * sum(deg)), 9) AS q FROM s""", graph=True)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    return processes.modularity(g.edges, g.nodes.select("id", (F.col("id") % 7).alias("community_id"))).select(F.round("q", 9).alias("q"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    inner = g.edges.where(_INSIDE)
    return processes.communities(g.nodes.where("kind IN ('Region', 'Nation', 'Customer', 'Supplier')"), inner)


_ENTRIES = """, flow AS (SELECT * FROM edges WHERE confidence >= 0.5 AND src <> dst),
entry AS (SELECT n.id, o.k AS callees, coalesce(i.k, 0) AS callers, o.k / (1.0 + coalesce(i.k, 0)) AS score FROM nodes n
  JOIN (SELECT src, count(*) AS k FROM flow GROUP BY src) o ON o.src = n.id LEFT JOIN (SELECT dst, count(*) AS k FROM flow GROUP BY dst) i ON i.dst = n.id
  WHERE NOT n.is_test ORDER BY score DESC, n.id LIMIT 200)"""
_TRACES = (
    _ENTRIES
    + """, callee AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY edge_id, dst) AS r FROM (SELECT src, dst, min(edge_id) AS edge_id FROM flow GROUP BY src, dst) QUALIFY r <= 4),
path AS (
  SELECT id AS entry, [id] AS steps, CAST([] AS BIGINT[]) AS turn FROM entry
  UNION ALL SELECT p.entry, list_append(p.steps, c.dst), list_append(p.turn, c.r) FROM path p JOIN callee c ON c.src = p.steps[-1] WHERE NOT list_contains(p.steps, c.dst) AND len(p.steps) < 10),
done AS (SELECT * FROM path p WHERE len(steps) >= 3 AND (len(steps) = 10 OR NOT EXISTS (SELECT 1 FROM callee c WHERE c.src = p.steps[-1] AND NOT list_contains(p.steps, c.dst)))),
trace AS (SELECT entry, steps FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY len(steps), turn) AS k FROM done) WHERE k <= 12)"""
)


@query(_ENTRIES + " SELECT * FROM entry", graph=True)
def process_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    return processes.entry_points(g.nodes, g.edges)


@query(_TRACES + " SELECT entry, steps FROM trace", graph=True)
def process_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    return processes.traces(processes.entry_points(g.nodes, g.edges), g.edges)


@query(_TRACES + """, s AS (SELECT *, ',' || array_to_string(steps, ',') || ',' AS t FROM trace),
whole AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE len(b.steps) > len(a.steps) AND contains(b.t, a.t)))
SELECT entry, terminal, steps FROM (SELECT entry, steps[-1] AS terminal, steps, row_number() OVER (PARTITION BY entry, steps[-1] ORDER BY len(steps) DESC, steps) AS k FROM whole) WHERE k = 1 ORDER BY len(steps) DESC, steps LIMIT 75""", graph=True)
def process_distinct_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    return processes.distinct_traces(processes.traces(processes.entry_points(g.nodes, g.edges), g.edges))


@query("SELECT conv_id AS process_id, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations")
def processes_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    stored = turns.groupBy(F.col("conv_id").alias("process_id")).agg(F.array_sort(F.collect_list("id")).alias("steps"))
    return processes.processes_containing(stored, turns).select("process_id", "id", F.col("step").cast("long").alias("step"))


# --- search

_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"
_IDENTIFIER = f"CASE WHEN len({_TOKENS.format('name')}) > 1 THEN list_prepend(lower(name), {_TOKENS.format('name')}) ELSE [lower(name)] END"


@query(f" SELECT id, {_IDENTIFIER} AS tokens FROM nodes", graph=True)
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce.graph(spark, sf_dir).nodes.select("id", X.identifier_tokens(F.col("name")).alias("tokens"))


def _bm25(key: str, source: str, terms: str) -> str:
    return f"""d AS (SELECT {key}, tokens, len(tokens) AS size FROM ({source})),
total AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
tf AS (SELECT {key}, size, term, count(*) AS tf FROM (SELECT {key}, size, unnest(tokens) AS term FROM d) WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term), total GROUP BY {key}"""


@query("WITH " + _bm25("doc_id", "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS tokens FROM documents", "'license', 'reserved', 'this', 'mit'"))
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search.bm25(table(spark, sf_dir, "documents"), "doc_id", search.words(F.col("text")), ["license", "reserved", "this", "mit"])
    return got.select("doc_id", F.round("score", 6).alias("score"))


@query(", " + _bm25("id", f"SELECT id, {_IDENTIFIER} AS tokens FROM nodes", "'small', 'bolt', 'order'"), graph=True)
def bm25_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25_stored(spark, commerce.name_index(spark, sf_dir), search.identifier_terms(spark, "small bolt order"), k=None)
    return found.select(F.col("key").alias("id"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small ring' THEN 1.0 WHEN starts_with(lower(p_name), 'small ring') THEN 0.7 ELSE 0.4 END::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'small ring')")
def substring_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring_rank(table(spark, sf_dir, "part"), "p_name", "Small ring").select("p_partkey", "p_name", "score")


@query("SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bucketed(table(spark, sf_dir, "documents"), "lang", 20, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("SELECT signature, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT n_chars % 97 AS signature, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100) GROUP BY signature")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = search.bucketed(docs, "source", 100, F.desc("n_chars"), F.col("doc_id")).withColumn("signature", F.col("n_chars") % 97)
    return search.fused(ranked, "signature").select("signature", F.round("score", 9).alias("score"))


@query(" SELECT n.id, n.name, n.kind, NULL::VARCHAR AS file_path, count(e.edge_id) AS callers FROM nodes n LEFT JOIN edges e ON e.dst = n.id WHERE contains(n.name, 'ring') GROUP BY n.id, n.name, n.kind", graph=True)
def find_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(commerce.graph(spark, sf_dir), "ring", fuzzy=True, everything=True)


@query(""" SELECT n.id, n.name, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS callers, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS callees,
  coalesce((SELECT (list(m.name ORDER BY e.edge_id))[1:3] FROM edges e JOIN nodes m ON m.id = e.src WHERE e.dst = n.id), []) AS first_callers,
  coalesce((SELECT (list(m.name ORDER BY e.edge_id))[1:3] FROM edges e JOIN nodes m ON m.id = e.dst WHERE e.src = n.id), []) AS first_callees
FROM nodes n WHERE n.kind = 'Nation'""", graph=True)
def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    return search.enriched(g, g.nodes.where("kind = 'Nation'").select("id", "name"))


@query("""WITH d AS (SELECT p_partkey AS id, p_name AS name, list_prepend(p_name, string_split(p_name, ' ')) AS tokens FROM part), total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
tf AS (SELECT id, name, size, term, count(*) AS tf FROM (SELECT id, name, len(tokens) AS size, unnest(tokens) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query, unnest(list_prepend(query, string_split(query, ' '))) AS term FROM (SELECT DISTINCT p_name AS query FROM part)),
s AS (SELECT query, id, name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 40""")
def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name as a query, with comments and blank lines between."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    lines = parts.select(F.explode(F.array(F.concat(F.lit("  "), "name"), F.concat(F.lit("# "), "name"), F.lit(" "))).alias("query"))
    return search.batch(parts, lines, 40).withColumn("rank", F.col("rank").cast("long"))


# --- routes and contracts

_PATH = r"regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), '\?.*$', ''), '^/+|/+$', '', 'g')"


@query("SELECT doc_id, lang || '/:*/' || source || '/:*/:*/x-{y}' AS path FROM documents")
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("/"), "lang", F.lit("/{id}/"), "source", F.lit("/:part/user-${id}/x-{y}/?page=2#top"))
    return table(spark, sf_dir, "documents").select("doc_id", X.route_path(raw).alias("path"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT a.page_id AS fetch_id, b.page_id AS route_id, path, 0.8::DOUBLE AS confidence FROM p a JOIN p b USING (path) WHERE a.page_id % 10 <> b.page_id % 7""")
def fetch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    fetches = pages.select(F.col("page_id").alias("fetch_id"), (F.col("page_id") % 10).alias("file_id"), F.lit("get").alias("method"), F.col("path").alias("url"))
    known = pages.select(F.col("page_id").alias("route_id"), (F.col("page_id") % 7).alias("file_id"), F.lit("GET").alias("method"), "path")
    return routes.matched_fetches(fetches, known)


@query("""WITH c AS (SELECT p_partkey AS edge_id, p_size AS node_id, list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda k: k NOT IN ('small', 'ring', 'red', 'blue'))) AS gone FROM part)
SELECT edge_id, node_id, CASE WHEN node_id > 40 THEN 'unknown_shape' WHEN len(gone) > 0 THEN 'drift' ELSE 'ok' END AS status, CASE WHEN node_id <= 40 THEN gone ELSE [] END AS missing, 2 AS fetches FROM c""")
def shape_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    consumers = parts.select(F.col("p_partkey").alias("edge_id"), F.col("p_size").alias("node_id"), X.reason(F.split("p_name", " "), F.lit(2)).alias("reason"))
    shapes = parts.where("p_size <= 40").select(F.col("p_size").alias("node_id")).distinct().select("node_id", F.array(*map(F.lit, ("small", "ring", "red"))).alias("response_keys"), F.array(F.lit("blue")).alias("error_keys"))
    return routes.shape_drift(consumers, shapes)


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS repo, c_nationkey AS symbol, 'http:' || CASE WHEN c_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END || ':/nation_' || c_nationkey AS id, 'consumer' AS role FROM customer),
x AS (SELECT * FROM c UNION ALL SELECT 'r' || n_regionkey, n_nationkey, 'http:GET:/nation_' || n_nationkey, 'provider' FROM nation),
d AS (SELECT *, row_number() OVER () AS own, list_filter(regexp_split_to_array(lower(id), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM x),
total AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT own, len(t) AS size, term, count(*) AS tf FROM (SELECT own, t, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
exact AS (SELECT a.own AS c, b.own AS p FROM d a JOIN d b ON a.id = b.id AND a.role = 'consumer' AND b.role = 'provider' AND a.repo <> b.repo),
q AS (SELECT own AS c, unnest(list_distinct(t)) AS term FROM d WHERE role = 'consumer' AND own NOT IN (SELECT c FROM exact)),
s AS (SELECT c, own AS p, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY 1, 2),
r AS (SELECT s.*, row_number() OVER (PARTITION BY c ORDER BY round(score, 9) DESC, b.repo, b.id, b.symbol, b.role) AS k FROM s JOIN d b ON b.own = p)
SELECT a.repo AS c_repo, a.symbol AS c_symbol, b.repo AS p_repo, b.symbol AS p_symbol, 1.0::DOUBLE AS confidence, 'exact' AS match_type FROM exact JOIN d a ON a.own = c JOIN d b ON b.own = p
UNION ALL SELECT a.repo, a.symbol, b.repo, b.symbol, round(score, 9), 'bm25' FROM r JOIN d a ON a.own = c JOIN d b ON b.own = p WHERE k <= 16 AND score >= 0.6 AND b.role = 'provider' AND a.repo <> b.repo""")
def contract_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    http = lambda verb, key: routes.contract_id("http", verb, F.concat(F.lit("/nation_"), F.col(key)))
    provided = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), http(F.lit("GET"), "n_nationkey").alias("contract_id"), F.lit("provider").alias("role"), F.col("n_nationkey").alias("symbol"))
    verb = F.when(F.col("c_nationkey") % 2 == 0, "GET").otherwise("POST")
    consumed = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("repo"), http(verb, "c_nationkey").alias("contract_id"), F.lit("consumer").alias("role"), F.col("c_nationkey").alias("symbol")).distinct()
    return routes.contract_links(provided.unionByName(consumed)).select("c_repo", "c_symbol", "p_repo", "p_symbol", F.round("confidence", 9).alias("confidence"), "match_type")


@query("""SELECT path, round(s, 9) AS score FROM (SELECT n_name AS path, (SELECT count(*) FROM range(1, least(length(n_name), 9) + 1) r(k) WHERE n_name[1:k] = 'NATION_2X'[1:k]) / greatest(length(n_name), 9)::DOUBLE AS s FROM nation) WHERE s > 0 ORDER BY s DESC, path LIMIT 5""")
def route_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.suggestions(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path")), "NATION_2X").select("path", F.round("score", 9).alias("score"))


# --- detectors


@query(" SELECT CASE WHEN reason = 'key' THEN 'keys' WHEN reason = 'O' THEN 'open' WHEN reason LIKE 'F%' THEN 'finished' END AS framework, count(*) AS n FROM edges WHERE reason IN ('key', 'O') OR reason LIKE 'F%' GROUP BY 1", graph=True)
def framework_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.frameworks(commerce.graph(spark, sf_dir).edges, {"key": "keys", "O": "open", "F*": "finished"})


@query("""WITH e AS (SELECT doc_id AS k, TRUE AS known, CASE quality WHEN 1 THEN doc_id % 3 END AS t FROM labels),
d AS (SELECT doc_id AS k, TRUE AS decided, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN lang = 'fr' THEN 9 ELSE doc_id % 3 END AS g, CASE WHEN doc_id % 5 = 0 THEN 'Unresolved' WHEN doc_id % 4 = 0 THEN 'SameFile' WHEN doc_id % 4 = 1 THEN 'ImportScoped' WHEN doc_id % 4 = 2 THEN 'Global' ELSE 'AmbiguousGlobal' END AS tier, doc_id % 7 = 0 AND doc_id % 5 <> 0 AS alt FROM documents WHERE doc_id % 10 <> 0),
j AS (SELECT * FROM e FULL JOIN d USING (k)),
v AS (SELECT tier, CASE WHEN known IS NULL THEN CASE WHEN tier = 'SameFile' THEN 'decided_same_file' ELSE 'decided_other' END WHEN decided IS NULL THEN 'expected_only' WHEN g = t THEN 'TP' WHEN g IS NOT NULL THEN 'FP_ghost' WHEN t IS NOT NULL THEN 'FN' END AS verdict FROM j
UNION ALL SELECT tier, 'demoted' FROM j WHERE known AND g = t AND tier = 'Global' UNION ALL SELECT tier, 'FP_overmatch' FROM j WHERE known AND g = t AND alt)
SELECT tier, verdict, count(*) AS n FROM v WHERE verdict IS NOT NULL GROUP BY 1, 2""")
def resolver_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as what is expected, documents as decisions, each with a second one that is not resolved."""
    expected = table(spark, sf_dir, "labels").selectExpr("doc_id AS key", "IF(quality = 1, concat('./s/', doc_id % 3, '.d.ts'), NULL) AS target")
    made = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    first = made.where("doc_id % 5 <> 0").selectExpr("doc_id AS key", "IF(lang = 'fr', 'x.ts', concat('s/', doc_id % 3, '/index.js')) AS target", "CASE doc_id % 4 WHEN 0 THEN 'SameFile' WHEN 1 THEN 'ImportScoped' WHEN 2 THEN 'Global' ELSE 'AmbiguousGlobal' END AS tier", "IF(doc_id % 7 = 0, 1, 0) AS alt_count")
    second = made.selectExpr("doc_id AS key", "CAST(NULL AS STRING) AS target", "'Unresolved' AS tier", "0 AS alt_count")
    return detect.verify(expected, first.unionByName(second), "typescript")


@query("SELECT l_orderkey AS change, count(*) AS touched, CASE WHEN count(*) <= 5 THEN 'low' WHEN count(*) <= 30 THEN 'medium' ELSE 'high' END AS risk FROM lineitem GROUP BY 1")
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.risk(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "change"), "change")


@query("""WITH x AS (SELECT DISTINCT c_nationkey AS n, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT l.n AS a, r.n AS b, count(*) AS common FROM x l JOIN x r ON l.p = r.p AND l.n < r.n GROUP BY 1, 2""")
def change_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return detect.conflicts(lines, "c_nationkey", "l_partkey")


@query("""WITH g AS (SELECT p_name, p_brand AS directory, p_type AS extension, bool_or(p_size % 3 = 0) AS r, bool_or(p_size % 3 <> 0) AS w FROM part GROUP BY 1, 2, 3),
j AS (SELECT a.directory, a.extension, a.p_name AS read, b.p_name AS written, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE AS likeness FROM g a JOIN g b USING (directory, extension) WHERE a.r AND NOT a.w AND b.w AND NOT b.r)
SELECT directory, extension, read, written, round(likeness, 9) AS likeness FROM j WHERE likeness >= 0.6""")
def literal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = F.when(F.col("p_size") % 3 == 0, "read").otherwise("write")
    literals = table(spark, sf_dir, "part").select(F.col("p_name").alias("literal"), F.col("p_brand").alias("directory"), F.col("p_type").alias("extension"), access.alias("access"))
    return detect.literal_pairs(literals, 0.6).select("directory", "extension", "read", "written", F.round("likeness", 9).alias("likeness"))


@query("SELECT p_name AS uid, 'Method' AS kind, count(*) AS n, 'method-overload' AS cause FROM part GROUP BY p_name HAVING count(*) > 1")
def uid_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.uid_collisions(table(spark, sf_dir, "part").select(F.col("p_name").alias("uid"), F.lit("Method").alias("kind"), F.col("p_size").alias("start_row"), F.col("p_brand").alias("owner_class")))


@query("WITH c AS (SELECT lang AS language, source AS cause, count(*) AS n FROM documents GROUP BY 1, 2) SELECT language, cause, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, language, cause LIMIT 10")
def hint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.audit(table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("hint")), 10)


# --- differences


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("owner"), (F.col("doc_id") % 500).cast("string").alias("name"), F.lit("Function").alias("kind"), F.col("n_chars").alias("content_hash"), F.col("doc_id").alias("id"))
    later = docs.withColumn("content_hash", F.col("content_hash") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return docs.where("doc_id % 10 <> 0 AND path <> 'src3'"), later.where("doc_id % 10 <> 1 AND path <> 'src4'")


_TWO = """s AS (SELECT source AS path, lang AS owner, CAST(doc_id % 500 AS VARCHAR) AS name, doc_id, n_chars FROM documents),
o AS (SELECT path, owner, name, arg_min(n_chars, doc_id) AS h FROM s WHERE doc_id % 10 <> 0 AND path <> 'src3' GROUP BY 1, 2, 3),
n AS (SELECT path, owner, name, arg_min(n_chars + (doc_id % 7 = 0)::INT, doc_id) AS h FROM s WHERE doc_id % 10 <> 1 AND path <> 'src4' GROUP BY 1, 2, 3)"""


@query(f"""WITH {_TWO} SELECT path, owner, name, 'Function' AS kind, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM o FULL JOIN n USING (path, owner, name) WHERE (o.h IS DISTINCT FROM n.h) AND path IN (SELECT path FROM o) AND path IN (SELECT path FROM n)""")
def symbol_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.symbols(*_two(spark, sf_dir))


@query(f"WITH {_TWO} SELECT path, 'added' AS status FROM (SELECT path FROM n EXCEPT SELECT path FROM o) UNION ALL SELECT path, 'removed' FROM (SELECT path FROM o EXCEPT SELECT path FROM n)")
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.files(*_two(spark, sf_dir))


@query("""WITH o AS (SELECT o_custkey AS src_file, o_orderkey AS name, o_orderstatus AS target, o_orderpriority AS tier FROM orders WHERE o_orderkey % 13 <> 0),
n AS (SELECT o_custkey AS src_file, o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS target, CASE WHEN o_orderkey % 7 = 0 THEN 'T' ELSE o_orderpriority END AS tier FROM orders WHERE o_orderkey % 11 <> 0)
SELECT src_file, name, CASE WHEN o.target IS NULL THEN 'new' WHEN n.target IS NULL THEN 'removed' WHEN o.target <> n.target THEN 'target_change' ELSE 'tier_change' END AS change
FROM o FULL JOIN n USING (src_file, name) WHERE o.target IS DISTINCT FROM n.target OR o.tier IS DISTINCT FROM n.tier""")
def binding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda target, tier, rows: table(spark, sf_dir, "orders").where(rows).select(F.col("o_custkey").alias("src_file"), F.col("o_orderkey").alias("name"), F.expr(target).alias("target_file"), F.expr(tier).alias("tier"))
    return diff.bindings(made("o_orderstatus", "o_orderpriority", "o_orderkey % 13 <> 0"), made("CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END", "CASE WHEN o_orderkey % 7 = 0 THEN 'T' ELSE o_orderpriority END", "o_orderkey % 11 <> 0"))


@query("""WITH v AS (SELECT p_brand AS brand, CASE p_size % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'removed' ELSE 'added' END AS status, p_size % 2 = 0 AS pub, p_size % 5 AS intra, p_size % 4 AS crs FROM part),
w AS (SELECT brand, CASE WHEN status = 'added' THEN 'Info' WHEN status = 'removed' AND pub THEN 'Risk' WHEN crs > 0 THEN 'Risk' WHEN intra > 0 THEN 'Warn' ELSE 'Info' END AS verdict FROM v)
SELECT brand, verdict, count(*) AS n FROM w GROUP BY 1, 2""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") % 3 == 0, "changed").when(F.col("p_size") % 3 == 1, "removed").otherwise("added")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), status.alias("status"), (F.col("p_size") % 2 == 0).alias("public"), (F.col("p_size") % 5).alias("intra"), (F.col("p_size") % 4).alias("cross"))
    return diff.verdicts(rows).groupBy("brand", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS uid, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("price"), "p_size")
    overlay = base.where("p_size > 40").withColumn("price", F.col("price") * 2)
    return diff.merged(overlay, base).select("uid", "price")


@query("""SELECT doc_id AS uid, CASE WHEN doc_id % 20 = 1 THEN 'resolve' WHEN doc_id % 20 NOT IN (1, 2, 3, 4) THEN 'keep' WHEN doc_id % 20 = 2 THEN 'resolve' WHEN doc_id % 7 <> 0 AND doc_id % 10 <> 0 AND n_chars <> 0 THEN 'keep' ELSE 'resolve' END AS action FROM documents""")
def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), (F.col("doc_id") % 20).alias("file_id"), F.col("n_chars").alias("content_hash"))
    new = docs.withColumn("content_hash", F.col("content_hash") + F.when(F.col("uid") % 7 == 0, 1).otherwise(0))
    facts = spark.range(1, 5).select(F.col("id").alias("file_id"), (F.col("id") == 1).alias("schema_changed"), F.lit(True).alias("touched"), (F.col("id") == 2).alias("imports_changed"))
    return diff.incremental(docs.where("uid % 10 <> 0"), new, facts)


@query("SELECT doc_id FROM documents WHERE lang || '/' || source IN (SELECT lang || '/' || source FROM documents WHERE doc_id % 90 = 0)")
def findings_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scope = docs.where("doc_id % 90 = 0").select(F.concat_ws("/", "lang", "source").alias("entry")).distinct()
    return diff.in_scope(docs.select("doc_id", F.concat_ws("/", F.lit("repo"), "lang", "source").alias("path")), "path", scope).select("doc_id")


# --- resolution and derivation


@query("""WITH s AS (SELECT p_partkey AS id, p_size AS f, p_name AS name, p_brand AS own, p_type AS lang FROM part),
r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_linenumber % 2 = 1 THEN f END AS f, name, CASE WHEN l_linenumber % 3 = 0 THEN own END AS q, lang FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN s ON id = l_partkey),
c AS (SELECT ref_id, s.id, 0 AS tier FROM r JOIN s ON r.f = s.f AND r.name = s.name
  UNION SELECT ref_id, s.id, 2 FROM r JOIN s ON r.q = s.own AND r.name = s.name
  UNION SELECT ref_id, s.id, 4 FROM r JOIN s ON r.lang = s.lang AND r.name = s.name),
u AS (SELECT ref_id, tier, min(id) AS id FROM c GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier) AS k FROM u)
SELECT ref_id, id, CASE tier WHEN 0 THEN 'same_file' WHEN 2 THEN 'qualifier' ELSE 'unique_global' END AS tier, CASE tier WHEN 0 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM b WHERE k = 1""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("file_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"), F.col("p_type").alias("language"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    refs = lines.join(symbols, F.col("id") == F.col("l_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.when(F.col("l_linenumber") % 2 == 1, F.col("file_id")).alias("file_id"), "name",
        F.when(F.col("l_linenumber") % 3 == 0, F.col("owner")).alias("qualifier"), F.lit(None).cast("string").alias("owner"), "language",
    )
    return derive.resolve(refs, symbols)


@query("""WITH s AS (SELECT p_partkey AS id, p_size AS f, p_name || p_partkey % 40 AS name, p_brand AS own, CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Class' WHEN 2 THEN 'Property' ELSE 'Import' END AS kind, p_size % 5 = 0 AS vendor, p_type AS module FROM part),
r AS (SELECT id AS ref_id, f + 1 AS f, name, own, CASE id % 3 WHEN 0 THEN 'callable' WHEN 1 THEN 'type' END AS target, id % 7 = 0 AS vendor, CASE WHEN id % 11 = 0 THEN module END AS module FROM s),
c AS (SELECT ref_id, s.id, 0 AS tier FROM r JOIN s USING (f, name)
  UNION SELECT ref_id, s.id, 1 FROM r JOIN s ON s.f = r.f + 3 AND s.name = r.name AND r.f % 4 = 0
  UNION SELECT ref_id, s.id, 3 FROM r JOIN s ON s.module = r.module AND s.name = r.name
  UNION SELECT ref_id, s.id, 4 FROM r JOIN s ON s.own = 'Brand#' || (CAST(replace(r.own, 'Brand#', '') AS INTEGER) + 1) AND s.name = r.name
  UNION SELECT ref_id, s.id, 5 FROM r JOIN s ON s.name = r.name AND (r.vendor OR NOT s.vendor) AND (r.target IS NULL OR r.target = 'callable' AND s.kind = 'Method' OR r.target = 'type' AND s.kind = 'Class')),
u AS (SELECT ref_id, tier, min(id) AS id FROM c GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT ref_id, arg_min(id, tier) AS id, ['same_file', 'import', 'qualifier', 'module_tree', 'heritage', 'unique_global'][min(tier) + 1] AS tier FROM u GROUP BY 1""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers, kinds and the barrier around vendored code."""
    part = table(spark, sf_dir, "part")
    name = "concat(p_name, p_partkey % 40) AS name"
    symbols = part.selectExpr("p_partkey AS id", "p_size AS file_id", name, "p_brand AS owner", "'x' AS language", "CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Class' WHEN 2 THEN 'Property' ELSE 'Import' END AS kind", "p_size % 5 = 0 AS is_vendor", "p_type AS module")
    refs = part.selectExpr("p_partkey AS ref_id", "p_size + 1 AS file_id", name, "CAST(NULL AS STRING) AS qualifier", "p_brand AS owner", "'x' AS language", "CASE p_partkey % 3 WHEN 0 THEN 'callable' WHEN 1 THEN 'type' END AS target", "p_partkey % 7 = 0 AS is_vendor", "IF(p_partkey % 11 = 0, p_type, NULL) AS module")
    imports = refs.where("file_id % 4 = 0").selectExpr("file_id", "name", "file_id + 3 AS target_file").distinct()
    heritage = part.selectExpr("p_brand AS owner", "concat('Brand#', CAST(replace(p_brand, 'Brand#', '') AS INT) + 1) AS parent").distinct()
    return derive.resolve(refs, symbols, imports, heritage).select("ref_id", "id", "tier")


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers and suppliers lie in the community of their own nation: all of them."""
    found = communities(spark, sf_dir)
    c = lambda name: found.select(F.col("id").alias(name), F.col("community_id").alias(f"{name}_c"))
    edges = commerce.graph(spark, sf_dir).edges.where("rel_type = 'IN_NATION'")
    return edges.join(c("src"), "src").join(c("dst"), "dst").where("src_c = dst_c").groupBy((F.col("dst") - 2 * STEP).cast("int").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS ref_id, l_partkey AS dst, round(greatest(0.9 / sqrt(count(*) OVER (PARTITION BY l_orderkey)), 0.1), 9) AS confidence FROM lineitem")
def fan_out_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = derive.fan_out(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref_id"), F.col("l_partkey").alias("dst")), 0.9)
    return got.select("ref_id", "dst", F.round("confidence", 9).alias("confidence"))


@query("""SELECT DISTINCT a.p_partkey AS src, b.p_partkey AS dst, 0.9::DOUBLE AS confidence FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_name = b.p_name AND (a.p_type = b.p_type OR a.p_brand = b.p_brand)""")
def schema_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.schema_mirrors(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("owner")))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'staging/http/' ELSE 'prod/' END || replace(lower(p_name), ' ', '/') || CASE p_size % 2 WHEN 0 THEN '/created' ELSE '/http/server/v3' END AS topic FROM part")
def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.expr("CASE p_size % 2 WHEN 0 THEN '-Created.v2' ELSE ':HTTPServer_v3' END")
    raw = F.concat(F.expr("CASE p_size % 3 WHEN 0 THEN 'prod.' WHEN 1 THEN 'staging/HTTP.' ELSE 'dev.prod.' END"), F.translate("p_name", " ", "_"), ends)
    return table(spark, sf_dir, "part").select("p_partkey", X.topic(raw).alias("topic"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS k, p_brand AS lib, p_size % 2 = 0 AS pub FROM part), f AS (SELECT k, lib, min(id) AS src FROM t WHERE pub GROUP BY 1, 2)
SELECT src, id AS dst, 0.85::DOUBLE AS confidence FROM t JOIN f USING (k, lib) WHERE NOT pub""")
def topic_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("p_size") % 2 == 0, "publish").otherwise("subscribe")
    return derive.topic_mirrors(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("lib"), role.alias("role")))


# --- telemetry, in batch and as a stream


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.concat(F.lit("tool"), F.col("user_id") % 10).alias("tool"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("error_kind"))


_CALLS = "SELECT ts, 'tool' || (user_id % 10) AS tool, value AS duration, event_type <> 'error' AS ok FROM events"


@query(f"""SELECT tool, count(*) AS calls, (list_sort(list(duration)))[CAST(floor((count(*) - 1) * 50 / 100) AS BIGINT) + 1] AS p50, (list_sort(list(duration)))[CAST(floor((count(*) - 1) * 99 / 100) AS BIGINT) + 1] AS p99,
  round(count(*) FILTER (NOT ok) / count(*)::DOUBLE, 4) AS error_rate FROM ({_CALLS}) GROUP BY tool""")
def telemetry_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.by_tool(_calls(spark, sf_dir))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS calls FROM events GROUP BY 1)
SELECT r.hour, coalesce(calls, 0) AS calls FROM (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) r LEFT JOIN h USING (hour)""")
def telemetry_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.hourly(_calls(spark, sf_dir)).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "calls")


@query(f"SELECT tool, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, round(avg(CASE WHEN duration <= 10 THEN 1.0 ELSE 0.0 END), 6) AS within_budget FROM ({_CALLS}) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY tool")
def telemetry_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.usage(telemetry.since(_calls(spark, sf_dir), "2024-01-10 00:00:00"), 10.0)


@query("SELECT event_type AS error_kind, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def telemetry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.errors_by_kind(_calls(spark, sf_dir))


@query(f"SELECT date_trunc('hour', ts) AS hour, tool, count(*) AS calls, round(sum(duration), 6) AS duration FROM ({_CALLS}) GROUP BY 1, 2")
def stream_windowed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.plans.scratch import shared_dir
    import uuid

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    calls = events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("tool"), F.col("user_id") % 10).alias("tool"), F.col("value").alias("duration"))
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    counted = inbox.windowed_calls(calls)
    # All counts at once, as the input is complete; open windows would wait for the watermark.
    query = counted.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "tool", "calls", F.round("duration", 6).alias("duration"))
