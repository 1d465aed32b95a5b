"""Registered queries of reviews, groups of repositories, stored indexes and processes, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import processes, review, routes, search, traverse
from weftgraph.plans import model
from weftgraph.plans.code_queries import docs, parts
from weftgraph.plans.graph_queries import _IDENTIFIER
from weftgraph.plans.scratch import cut
from weftgraph.sources import commerce
from weftgraph.sources.commerce import STEP, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, graph: bool = False):
    """Register a function as a query of its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, f"WITH RECURSIVE {commerce.SQL}{sql}" if graph else sql
        return f

    return add


# --- changes

# Parts as symbols of the files of their brands: some are new, some gone, some altered.
_OLD = "p_brand AS path", "'Part' AS kind", "concat(p_name, '#', p_partkey) AS name", "p_size AS line", "CAST(p_size AS BIGINT) AS line_hash"
_NEW = "p_brand AS path", "'Part' AS kind", "concat(p_name, '#', p_partkey) AS name", "p_size + 1 AS line", "CAST(p_size + IF(p_partkey % 50 = 3, 1, 0) AS BIGINT) AS line_hash"
_CHANGED = "SELECT p_partkey, p_brand AS path, p_name || '#' || p_partkey AS name, CASE p_partkey % 50 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'modified' END AS change, CASE p_partkey % 50 WHEN 2 THEN 0 ELSE p_size + 1 END AS line FROM part WHERE p_partkey % 50 IN (1, 2, 3)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return review.changed_symbols(part.where("p_partkey % 50 <> 1").selectExpr(*_OLD), part.where("p_partkey % 50 <> 2").selectExpr(*_NEW))


@query(f"SELECT path, name, line, change FROM ({_CHANGED})")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("path", "name", "line", "change")


@query(
    f""", c AS ({_CHANGED}), walk AS (
  SELECT {5 * STEP} + p_partkey AS seed, {5 * STEP} + p_partkey AS node, 0 AS depth FROM c
  UNION SELECT w.seed, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 2 AND e.confidence >= 0.95 AND e.rel_type NOT IN ('IN_REGION', 'IN_NATION', 'SUPPLIED_BY')),
up AS (SELECT seed, node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2)
SELECT {5 * STEP} + p_partkey AS seed, change, 'impact' AS section, node, depth FROM c JOIN up ON seed = {5 * STEP} + p_partkey""",
    graph=True,
)
def impact_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    places = table(spark, sf_dir, "part").selectExpr(f"{5 * STEP} + p_partkey AS id", "p_brand AS path", "'Part' AS kind", "concat(p_name, '#', p_partkey) AS name")
    found = review.impact_of_changes(g, places, _changes(spark, sf_dir).select("path", "kind", "name", "change"), "up", 2, 0.95, heuristic=False)
    return found.select("seed", "change", "section", "node", "depth")


@query(f"""SELECT {3 * STEP} + c_custkey AS seed, 'downstream' AS section, {6 * STEP} + o_orderkey AS node, 1 AS depth, 'deterministic' AS bucket FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 50 = 1""")
def impact_of_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that nothing calls show the orders that they place."""
    g = commerce.graph(spark, sf_dir)
    symbol = "c_mktsegment AS path", "'Customer' AS kind", "c_name AS name", "1 AS line", "1L AS line_hash"
    people = table(spark, sf_dir, "customer")
    changes = review.changed_symbols(people.where("c_custkey % 50 <> 1").selectExpr(*symbol), people.selectExpr(*symbol))
    places = people.selectExpr(f"{3 * STEP} + c_custkey AS id", "c_mktsegment AS path", "'Customer' AS kind", "c_name AS name")
    found = review.impact_of_changes(g, places, changes.select("path", "kind", "name", "change"), "up", 3)
    return found.select("seed", "section", "node", "depth", "bucket")


@query("""WITH o AS (SELECT 'route' AS kind, url || '#' || page_id AS id, page_id % 3 AS k FROM pages WHERE page_id % 11 <> 1 UNION ALL SELECT 'fetch', CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE source || doc_id END, 0 FROM documents WHERE doc_id % 13 <> 1),
n AS (SELECT 'route' AS kind, url || '#' || page_id AS id, CASE page_id % 11 WHEN 3 THEN 9 ELSE page_id % 3 END AS k FROM pages WHERE page_id % 11 <> 2 UNION ALL SELECT 'fetch', CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE source || doc_id END, 0 FROM documents WHERE doc_id % 13 <> 2)
SELECT kind, id AS identifier, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'modified' END AS status FROM o FULL JOIN n USING (kind, id) WHERE o.k IS DISTINCT FROM n.k""")
def contracts_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def snapshot(gone: int, altered: int) -> DataFrame:
        pages = table(spark, sf_dir, "pages").where(F.col("page_id") % 11 != gone)
        known = pages.selectExpr("page_id AS id", "concat(url, '#', page_id) AS name")
        shapes = pages.selectExpr("page_id AS node_id", f"array(concat('k', IF(page_id % 11 = {altered}, 9, page_id % 3))) AS response_keys")
        fetches = table(spark, sf_dir, "documents").where(F.col("doc_id") % 13 != gone).selectExpr("doc_id AS edge_id", "IF(doc_id % 2 = 0, concat('r', doc_id), '') AS reason", "concat(source, doc_id) AS src_name")
        return review.contracts(known, shapes, fetches)

    return review.contracts_diff(snapshot(1, -1), snapshot(2, 3))


# --- findings and sites


@query("""SELECT n.doc_id AS id, s.lang AS kind, count(*) AS n FROM documents n JOIN documents s ON s.source = n.source AND s.n_chars > 3000 WHERE n.doc_id % 10 = 0 GROUP BY 1, 2""")
def blind_spot_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = table(spark, sf_dir, "documents").where("n_chars > 3000").selectExpr("lang AS kind", "source AS file_path")
    return review.blind_spot_warning(table(spark, sf_dir, "documents").where("doc_id % 10 = 0").selectExpr("doc_id AS id", "source AS file_path"), spots)


@query("""WITH u AS (SELECT l_partkey AS dst, max(l_orderkey * 10 + l_linenumber) AS edge_id FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
e AS (SELECT DISTINCT l_partkey AS dst, l_orderkey * 10 + l_linenumber AS edge_id, l_suppkey AS src, l_returnflag AS reason FROM lineitem)
SELECT p.p_partkey AS id, 'S' || min(e.src) AS enclosing, coalesce(min(e.reason), '') AS sink_reason FROM part p LEFT JOIN u ON u.dst = p.p_partkey LEFT JOIN e ON e.dst = u.dst AND e.edge_id = u.edge_id WHERE p.p_name = 'small ring' GROUP BY 1""")
def path_literal_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "'PathLiteral' AS kind", "p_name AS name").unionByName(table(spark, sf_dir, "supplier").selectExpr("-s_suppkey AS id", "'Function' AS kind", "concat('S', s_suppkey) AS name"))
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 40").selectExpr("l_orderkey * 10 + l_linenumber AS edge_id", "-l_suppkey AS src", "l_partkey AS dst", "l_returnflag AS reason", "'UsesPathLiteral' AS rel_type")
    # Order lines may repeat; of equal edges the one with the smallest caller and reason counts.
    uses = uses.groupBy("edge_id", "dst", "rel_type").agg(F.min(F.struct((-F.col("src")).alias("src"), "reason")).alias("u")).select("edge_id", "dst", "rel_type", (-F.col("u.src")).alias("src"), "u.reason")
    return review.literal_sites(nodes, uses, "small ring")


@query("""SELECT 'blind_spot' AS section, source AS path, doc_id AS line, 'info' AS severity, 'blind spot: ' || lang AS detail FROM documents WHERE n_chars > 3000
UNION ALL SELECT 'egress', source, doc_id, 'info', 'external call: get (package: ' || lang || ')' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'shape_drift', source, doc_id, 'warn', 'missing keys: a, ' || lang FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'resolver', source, 0, 'warn', 'n' || doc_id || ': ' || CASE doc_id % 3 WHEN 0 THEN 'none' ELSE 'import' END || ' -> global' FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT 'literal', min(source || '/w.py'), min(doc_id), 'warn', 'reads a.' || lang || ' but writes b.' || lang FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY source) AS r FROM documents) WHERE r = 1 AND lang IN (SELECT lang FROM documents WHERE source = 'src7') GROUP BY lang""")
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda *columns: docs(spark, sf_dir, *columns)
    found = [
        review.blind_spot_findings(d("lang AS kind", "source AS path", "doc_id AS start_row", "n_chars").where("n_chars > 3000")),
        review.egress_findings(d("source AS path", "doc_id AS line", "'get' AS callee", "lang AS package"), d("source AS path", "doc_id AS line").where("line % 3 = 0")),
        review.drift_findings(d("source AS path", "doc_id AS line", "IF(doc_id % 5 = 0, 'drift', 'ok') AS status", "array('a', lang) AS missing")),
        review.tier_findings(d("source AS path", "concat('n', doc_id) AS name", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'import' ELSE 'global' END AS before", "'global' AS after")),
        review.literal_findings(d("concat('a.', lang) AS read", "concat('b.', lang) AS written", "concat(source, '/r.py') AS read_path", "concat(source, '/w.py') AS write_path", "doc_id AS write_line"), spark.range(1).selectExpr("'src7/r.py' AS entry")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4])


# --- groups


_LINKS = "SELECT c_custkey AS c_symbol, c_nationkey AS p_symbol, (c_custkey % 10) / 10.0 AS confidence FROM customer"


@query(f"SELECT c_symbol, p_symbol, confidence::DOUBLE AS confidence FROM ({_LINKS}) WHERE confidence >= 0.3 AND (c_symbol % 40 = 0 OR p_symbol % 8 = 0 AND p_symbol <= 24)")
def group_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS c_symbol", "concat('p', c_nationkey) AS p_symbol", "(c_custkey % 10) / 10D AS confidence")
    local = table(spark, sf_dir, "customer").where("c_custkey % 40 = 0").selectExpr("concat('c', c_custkey) AS symbol").unionByName(table(spark, sf_dir, "nation").where("n_nationkey % 8 = 0").selectExpr("concat('p', n_nationkey) AS symbol"))
    return routes.group_impact(local, links, 0.3).selectExpr("CAST(substring(c_symbol, 2) AS BIGINT) AS c_symbol", "CAST(substring(p_symbol, 2) AS INT) AS p_symbol", "confidence")


@query("SELECT p_brand AS repo, count(*) AS nodes, count(*) FILTER (p_type IN ('SMALL', 'LARGE')) AS symbols, count(*) FILTER (p_type = 'ECONOMY') AS files FROM part GROUP BY 1")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.group_summary(parts(spark, sf_dir, "p_brand AS repo", "CASE p_type WHEN 'SMALL' THEN 'Class' WHEN 'LARGE' THEN 'Function' WHEN 'ECONOMY' THEN 'File' ELSE 'Import' END AS kind"))


@query("SELECT contract_id, CASE WHEN c % 2 = 0 THEN true ELSE false END AS matched FROM (SELECT n_nationkey AS c, 'grpc:N' || n_nationkey || ':*' AS contract_id FROM nation)")
def group_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), routes.contract_id("grpc", F.concat(F.lit("N"), "n_nationkey")).alias("contract_id"), F.col("n_nationkey").alias("symbol"))
    links = each.where("symbol % 2 = 0").select(F.col("repo").alias("c_repo"), F.col("symbol").alias("c_symbol"), F.lit("x").alias("p_repo"), F.lit(-1).alias("p_symbol"))
    return routes.unmatched(each, links).select("contract_id", "matched")


@query("SELECT n_name AS repo, CASE WHEN n_nationkey % 4 = 0 THEN 'Missing' WHEN n_nationkey % 4 = 1 THEN 'NoSnapshot' WHEN n_regionkey = 0 THEN 'Ok' ELSE 'Stale(' || n_regionkey || ')' END AS status FROM nation")
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    members = nation.selectExpr("n_name AS repo", "n_nationkey % 4 <> 0 AS exists", "10 + n_regionkey AS head_no")
    return routes.member_status(members, nation.where("n_nationkey % 4 <> 1").selectExpr("n_name AS repo", "10 AS built_no"))


@query("""SELECT repo, id, score FROM (SELECT 'a' AS repo, doc_id AS id, n_chars::DOUBLE AS score FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id, n_chars / 2.0 FROM documents WHERE lang <> 'en') ORDER BY score DESC, repo, id LIMIT 100""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "documents")
    return search.merged_hits([every.where("lang = 'en'").selectExpr("'a' AS repo", "doc_id AS id", "CAST(n_chars AS DOUBLE) AS score"), every.where("lang <> 'en'").selectExpr("'b' AS repo", "doc_id AS id", "n_chars / 2D AS score")])


# --- search


@query(f""", d AS (SELECT id, {_IDENTIFIER} AS tokens FROM nodes), total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
tf AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(tokens) AS size, unnest(tokens) AS term FROM d) WHERE term IN ('small', 'bolt', 'order') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term), total GROUP BY id)
SELECT score, count(*) AS n, (SELECT count(*) FROM s) AS total FROM (SELECT score FROM s ORDER BY score DESC, id LIMIT 100) GROUP BY 1""", graph=True)
def stored_index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the hundred best nodes of an index on disk, and how many match in all."""
    found = search.bm25_stored(spark, commerce.name_index(spark, sf_dir), search.identifier_terms(spark, "small bolt order"))
    return found.groupBy(F.round("score", 6).alias("score"), "total").agg(F.count(F.lit(1)).alias("n")).select("score", "n", "total")


@query(f""", d AS (SELECT id, {_IDENTIFIER} AS tokens FROM nodes), total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
tf AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, len(tokens) AS size, unnest(tokens) AS term FROM d) WHERE term IN ('where', 'supplier', 'supplier_7', '7') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term), total GROUP BY id)
SELECT score, count(*) AS n FROM (SELECT score FROM s ORDER BY score DESC, id LIMIT 5) GROUP BY 1""", graph=True)
def prompt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the five best nodes for the identifiers of a prompt."""
    asked = " ".join(search.prompt_terms("Where is Supplier_7 ?"))
    found = search.bm25_stored(spark, commerce.name_index(spark, sf_dir), search.identifier_terms(spark, asked), k=5)
    return found.groupBy(F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id FROM part WHERE p_name IN (SELECT min(p_name) FROM part)")
def find_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce.graph(spark, sf_dir)
    first = table(spark, sf_dir, "part").agg(F.min("p_name").alias("n")).first()["n"]
    return search.find(g, first, everything=True).select((F.col("id") - 5 * STEP).alias("id"))


# --- routes, tools and processes


def _route_graph(spark: SparkSession, sf_dir: str) -> model.PropertyGraph:
    """Pages as routes, documents as the functions that handle and call them."""
    pages = table(spark, sf_dir, "pages").selectExpr("1000000 + page_id AS id", "concat('GET /p/', page_id) AS name", "'Route' AS kind", "page_id % 20 AS file_id")
    functions = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "concat('f', doc_id) AS name", "'Function' AS kind", "doc_id % 20 AS file_id")
    handles = table(spark, sf_dir, "pages").selectExpr("page_id AS edge_id", "page_id AS src", "1000000 + page_id AS dst", "'HandlesRoute' AS rel_type", "CAST(1.0 AS FLOAT) AS confidence", "'h' AS reason")
    calls = table(spark, sf_dir, "documents").where("doc_id >= 2").selectExpr("1000000 + doc_id AS edge_id", "doc_id AS src", "doc_id DIV 2 AS dst", "'Calls' AS rel_type", "CAST(1.0 AS FLOAT) AS confidence", "'c' AS reason")
    files = spark.range(20).selectExpr("id AS file_id", "concat(IF(id % 5 = 0, 'tests/', 'src/'), 'f', id, '.py') AS path", "0L AS mtime", "id AS content_hash", "IF(id % 5 = 0, 'Test', 'Source') AS category", "'python' AS language")
    return model.PropertyGraph(pages.unionByName(functions), handles.unionByName(calls), files=files)


_WALK = """walk AS (SELECT 3 AS seed, 3 AS node, 0 AS depth UNION SELECT w.seed, d.doc_id, w.depth + 1 FROM walk w JOIN documents d ON d.doc_id // 2 = w.node AND d.doc_id >= 2 WHERE w.depth < 4{0})"""


@query("WITH RECURSIVE " + _WALK.format(" AND d.doc_id % 20 % 5 <> 0") + " SELECT node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1")
def impact_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers up to four steps away; those in test files are neither reached nor gone on from."""
    seeds = spark.range(1).selectExpr("3L AS seed")
    return traverse.impact(_route_graph(spark, sf_dir), seeds, "up", 4, tests=False).select("node", "depth")


@query("SELECT 1000000 + page_id AS id, 'GET /p/' || page_id AS name, CASE WHEN page_id % 20 % 5 = 0 THEN 'tests/' ELSE 'src/' END || 'f' || page_id % 20 || '.py' AS file_path FROM pages")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_graph(spark, sf_dir).node_view({"file_path"}).where("kind = 'Route'").select("id", "name", "file_path")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.selectExpr("conv_id * 1000 + turn AS id", "concat(role, turn) AS name")
    stored = turns.groupBy(F.col("conv_id").alias("process_id")).agg(F.array_sort(F.collect_list(F.col("conv_id") * 1000 + F.col("turn"))).alias("steps"))
    stored = stored.join(processes.process_nodes(stored, nodes), "process_id").withColumns({"communities": F.array((F.col("process_id") % 3).cast("int")), "process_type": F.lit("intra")})
    return cut(stored, "processes"), nodes


_LABELS = "l AS (SELECT conv_id AS process_id, arg_min(role || turn, turn) || ' → ' || arg_max(role || turn, turn) AS label, count(*) AS n_steps FROM conversations GROUP BY 1)"


@query(f"WITH {_LABELS} SELECT * FROM l WHERE process_id % 3 = 1 AND contains(lower(label), 'assistant') ORDER BY n_steps DESC, process_id LIMIT 20")
def list_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = _stored(spark, sf_dir)
    return processes.listed(stored, 1, "Assistant", 20).select("process_id", "label", F.col("n_steps").cast("long").alias("n_steps"))


@query(f"WITH {_LABELS} SELECT process_id, row_number() OVER (PARTITION BY process_id ORDER BY turn) AS step, role || turn AS name FROM conversations JOIN l ON conv_id = process_id WHERE contains(lower(label), 'assistant3')")
def trace_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, nodes = _stored(spark, sf_dir)
    return processes.traced(stored, nodes, "assistant3").select("process_id", F.col("step").cast("long").alias("step"), "name")


@query("SELECT conv_id AS process_id, arg_min(role || turn, turn) || ' → ' || arg_max(role || turn, turn) AS label FROM conversations GROUP BY 1")
def process_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0].select("process_id", "label")
