"""Registered queries of the filters, fallbacks and counts that operators have beside their main results, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import detect, diff, routes, tools
from weftgraph.plans import model
from weftgraph.plans.code_queries import docs, parts
from weftgraph.plans.scratch import folder
from weftgraph.sources import commerce, contracts, shapes
from weftgraph.sources.commerce import table
from weftgraph.streaming import inbox

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, graph: bool = False):
    """Register a function as a query of its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, f"WITH RECURSIVE {commerce.SQL}{sql}" if graph else sql
        return f

    return add


# --- the schema and its defaults

_BLIND = [(language, kind, language in model.INDIRECT_LANGUAGES) for language, kinds in model.BLIND_KINDS.items() for kind in kinds.split()]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{k}', {i})" for x, k, i in _BLIND) + ") AS t(language, kind, indirect_dispatch)")
def schema_blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_BLIND, "language string, kind string, indirect_dispatch boolean")


@query(f"SELECT {model.FORMAT_VERSION} AS format_version")
def schema_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(model.FORMAT_VERSION).alias("format_version"))


def _snippets(spark: SparkSession, sf_dir: str) -> model.PropertyGraph:
    """Documents as files, and as functions that span their first two lines; every other one has metadata."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    nodes = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), F.lit("f").alias("name"), F.lit("Function").alias("kind"), F.lit(0).alias("start_row"), F.lit(0).alias("start_col"), F.lit(1).alias("end_row"), F.coalesce(F.octet_length(F.get(lines, 1)), F.lit(0)).alias("end_col"))
    meta = d.where("doc_id % 2 = 0").selectExpr("doc_id AS node_id", "lang = 'en' AS is_test", "true AS is_async", "false AS is_static", "false AS is_abstract", "false AS is_generator", "false AS is_extern", "CAST(doc_id % 4 AS INT) AS visibility", "IF(lang = 'fr', NULL, array(concat('@', source), lang)) AS decorators")
    edges = d.where("false").selectExpr("doc_id AS edge_id", "doc_id AS src", "doc_id AS dst", "'' AS rel_type", "CAST(1 AS FLOAT) AS confidence", "'' AS reason")
    return model.PropertyGraph(nodes, edges, function_meta=meta, sources=d.select(F.col("doc_id").alias("file_id"), "text"))


@query("SELECT id, CASE WHEN len(l) > 1 THEN l[1] || chr(10) || l[2] ELSE '' END AS content FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents)")
def node_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippets(spark, sf_dir).node_view({"content"}).select("id", "content")


@query("""SELECT doc_id AS id, doc_id % 2 = 0 AND lang = 'en' AS is_test, doc_id % 2 = 0 AS is_async, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE 0 END AS visibility, CASE WHEN doc_id % 2 = 0 AND lang <> 'fr' THEN [source, lang] ELSE [] END AS decorators FROM documents""")
def function_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorators without their signs, and the defaults of functions that have no metadata."""
    return _snippets(spark, sf_dir).node_view({"is_test", "is_async", "visibility", "decorators"}).select("id", "is_test", "is_async", F.col("visibility").cast("long").alias("visibility"), "decorators")


# --- inspection


@query(" SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0 AS files, (SELECT count(*) FROM nodes WHERE kind IN ('Part', 'Order')) AS symbols", graph=True)
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.metrics(commerce.graph(spark, sf_dir), ("Part", "Order"))


# Parts as symbols of fifty files of which every fifth is a test; order lines as calls, some of them guesses.
_CALLS = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE WHEN (l_suppkey + l_partkey) % 5 = 0 THEN 'MirrorsField' ELSE 'Calls' END AS rel_type FROM lineitem WHERE l_suppkey <> l_partkey"
_SYMBOLS = "SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Method' ELSE 'Class' END AS kind, p_size AS file_id, CASE WHEN p_size % 5 = 0 THEN 'tests/' ELSE 'src/' END || p_size || '.py' AS file_path, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS owner FROM part"


def _symbols(spark: SparkSession, sf_dir: str) -> model.PropertyGraph:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_name AS name", "CASE p_partkey % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Method' ELSE 'Class' END AS kind", "CAST(p_size AS LONG) AS file_id", "IF(p_partkey % 2 = 0, p_brand, NULL) AS owner_class", "CAST(p_partkey % 90 AS INT) AS start_row")
    files = parts(spark, sf_dir, "CAST(p_size AS LONG) AS file_id").distinct().selectExpr("file_id", "concat(IF(file_id % 5 = 0, 'tests/', 'src/'), file_id, '.py') AS path", "IF(file_id % 5 = 0, 'Test', 'Source') AS category", "'python' AS language")
    calls = table(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey").selectExpr("l_suppkey AS src", "l_partkey AS dst", "IF((l_suppkey + l_partkey) % 5 = 0, 'MirrorsField', 'Calls') AS rel_type").distinct()
    edges = calls.selectExpr("xxhash64(src, dst) AS edge_id", "src", "dst", "rel_type", "CAST(1 AS FLOAT) AS confidence", "'' AS reason")
    return model.PropertyGraph(nodes, edges, files=files)


@query(f"""WITH n AS ({_SYMBOLS}), e AS ({_CALLS}), s AS (SELECT src AS id, 'out' AS direction, rel_type, dst AS near FROM e UNION ALL SELECT dst, 'in', rel_type, src FROM e)
SELECT s.id, direction, rel_type = 'MirrorsField' AS heuristic, near, n.file_path FROM s JOIN n ON n.id = near WHERE kind IN ('Method', 'Class') AND contains(file_path, '1') AND file_path NOT LIKE 'tests/%'""")
def inspect_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of two kinds in files of a part of a path, without tests, sure and guessed ones apart."""
    return detect.neighbours(_symbols(spark, sf_dir), ("method", "CLASS"), ("Calls", "MirrorsField"), "1", tests=False).select("id", "direction", "heuristic", "near", "file_path")


@query(f"WITH n AS ({_SYMBOLS}), e AS ({_CALLS}) SELECT DISTINCT dst AS id, src AS near, name FROM e JOIN n ON n.id = src WHERE kind <> 'File'")
def inspect_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.upstream(detect.neighbours(_symbols(spark, sf_dir))).select("id", "near", "name")


# --- renames and tools

_TARGETS = f"n AS ({_SYMBOLS}), e AS ({_CALLS}), t AS (SELECT * FROM n WHERE name = 'blue bolt' AND owner IS NULL)"


@query(f"WITH {_TARGETS} SELECT file_id, sum(x)::BIGINT AS edges FROM (SELECT n.file_id, 1 AS x FROM e JOIN t ON t.id = e.dst JOIN n ON n.id = e.src WHERE rel_type = 'Calls' UNION ALL SELECT file_id, 0 FROM t) GROUP BY 1")
def rename_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _symbols(spark, sf_dir)
    return detect.rename_files(g, detect.rename_targets(g.nodes, "blue bolt"))


@query(f"WITH {_TARGETS} SELECT n.name, count(*) AS n FROM (SELECT e.src AS id FROM e JOIN t ON t.id = e.dst WHERE rel_type = 'MirrorsField' UNION ALL SELECT e.dst FROM e JOIN t ON t.id = e.src WHERE rel_type = 'MirrorsField') JOIN n USING (id) GROUP BY 1")
def rename_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _symbols(spark, sf_dir)
    return detect.rename_guesses(g, detect.rename_targets(g.nodes, "blue bolt"))


@query("SELECT p_partkey AS id, p_size AS file_id, p_partkey % 90 AS start_row FROM part WHERE p_name = 'blue gear'")
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rename_collisions(_symbols(spark, sf_dir), "blue gear")


# In English and German texts the words are joined by dots, in others by brackets; a first line imports a word.
_WORDS = """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE doc_id % 6 <> 0),
w AS (SELECT doc_id, lang, line, unnest(t) AS word, unnest(t[2:]) AS next, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'die' WHEN 'fr' THEN 'le' ELSE 'el' END AS local FROM (SELECT doc_id, lang, line, string_split(t, ' ') AS t FROM l)),
h AS (SELECT *, CASE WHEN lang IN ('en', 'de') THEN '.' || nullif(regexp_extract(next, '^[A-Za-z0-9_]+'), '') ELSE '(' END AS tail FROM w WHERE next IS NOT NULL AND regexp_matches(word, '(^|[^A-Za-z0-9_])' || local || '$')
  UNION ALL SELECT *, unnest(regexp_extract_all(word, '(?:^|[^A-Za-z0-9_])' || local || '(\\.[A-Za-z0-9_]+|\\()', 1)) FROM w)"""


@query(
    f"""{_WORDS} SELECT CASE lang WHEN 'en' THEN 'http' WHEN 'de' THEN 'db' WHEN 'fr' THEN 'queue' ELSE 'redis' END AS category, CASE lang WHEN 'en' THEN 'requests' WHEN 'de' THEN 'pg/lib' WHEN 'fr' THEN 'boto3' ELSE 'redis' END AS package,
CASE WHEN tail = '(' THEN local ELSE local || tail END AS callee, doc_id AS file_id, line + 1 AS line, count(*) AS n FROM h WHERE tail IS NOT NULL GROUP BY ALL"""
)
def tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of what each document imports; every sixth is a test and is not read."""
    d = table(spark, sf_dir, "documents")
    head = "CASE lang WHEN 'en' THEN 'import os, requests as the' WHEN 'de' THEN 'import pool, { Client as die } from \"pg/lib\";' WHEN 'fr' THEN 'import le \"boto3\"' ELSE 'use redis::{Client as el, b};' END"
    body = F.replace("text", F.lit(" "), F.when(F.col("lang").isin("en", "de"), ".").otherwise("("))
    lines = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split(F.concat(F.expr(head), F.lit("\n"), body), "\n")).alias("line", "text"))
    files = docs(spark, sf_dir, "doc_id AS file_id", "concat(IF(doc_id % 6 = 0, 'tests/', 'src/'), 'a', doc_id, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.go' ELSE '.rs' END) AS path")
    return tools.uses(lines, files).select("category", "package", "callee", "file_id", F.col("line").cast("long").alias("line"), "n")


# --- routes


def _inline_routes(spark: SparkSession, sf_dir: str) -> model.PropertyGraph:
    """Pages as routes of ten paths in twenty files, a third of them without a handler; documents as functions."""
    pages, d = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    nodes = pages.selectExpr("1000000 + page_id AS id", "concat('GET /p/', page_id % 10) AS name", "'Route' AS kind", "page_id % 20 AS file_id", "CAST(page_id AS INT) AS start_row", "CAST(page_id AS INT) AS end_row")
    nodes = nodes.unionByName(d.selectExpr("doc_id AS id", "concat('f', doc_id) AS name", "IF(doc_id % 7 = 0, 'Property', 'Function') AS kind", "doc_id % 20 AS file_id", "CAST(doc_id - 9 AS INT) AS start_row", "CAST(doc_id + doc_id % 30 AS INT) AS end_row"))
    handles = pages.where("page_id % 3 <> 0").selectExpr("page_id AS edge_id", "page_id AS src", "1000000 + page_id AS dst", "'HandlesRoute' AS rel_type", "CAST(1.0 AS FLOAT) AS confidence", "'h' AS reason")
    calls = d.where("doc_id >= 2").selectExpr("1000000 + doc_id AS edge_id", "doc_id AS src", "doc_id DIV 2 AS dst", "'Calls' AS rel_type", "CAST(1.0 AS FLOAT) AS confidence", "'c' AS reason")
    return model.PropertyGraph(nodes, handles.unionByName(calls))


@query("""WITH RECURSIVE r AS (SELECT page_id, 1000000 + page_id AS route_id FROM pages WHERE page_id % 10 = 4),
s AS (SELECT page_id, arg_min(doc_id, struct_pack(w := 9 + doc_id % 30, i := doc_id)) AS seed FROM pages JOIN documents ON doc_id % 20 = page_id % 20 AND doc_id % 7 <> 0 AND page_id BETWEEN doc_id - 9 AND doc_id + doc_id % 30 GROUP BY 1),
h AS (SELECT route_id, CASE WHEN page_id % 3 <> 0 THEN 'named' ELSE 'inline_anonymous' END AS handler, CASE WHEN page_id % 3 <> 0 THEN page_id ELSE seed END AS seed FROM r LEFT JOIN s USING (page_id)),
walk AS (SELECT DISTINCT seed, seed AS node, 0 AS depth FROM h WHERE seed IS NOT NULL UNION SELECT w.seed, d.doc_id, w.depth + 1 FROM walk w JOIN documents d ON d.doc_id // 2 = w.node AND d.doc_id >= 2 WHERE w.depth < 2)
SELECT route_id, handler, h.seed, node, min(depth) AS depth FROM h JOIN walk ON walk.seed = h.seed GROUP BY ALL UNION ALL SELECT route_id, handler, NULL, NULL, 0 FROM h WHERE seed IS NULL""")
def route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.inspect_route(_inline_routes(spark, sf_dir), "/p/4", 2)


@query("""SELECT p.page_id AS id, count(path) AS files, coalesce(max(confidence), 0)::DOUBLE AS best, coalesce(sum(confidence), 0)::DOUBLE AS total FROM pages p LEFT JOIN (SELECT doc_id // 4 AS r, lang AS path, max((doc_id % 8) / 8) AS confidence FROM documents GROUP BY 1, 2) ON r = p.page_id GROUP BY 1""")
def route_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers of each route, a file once with its greatest confidence."""
    routes_ = table(spark, sf_dir, "pages").selectExpr("page_id AS id", "'GET' AS method", "url AS path", "'f' AS file", "1 AS line")
    found = diff.route_consumers(routes_, docs(spark, sf_dir, "doc_id DIV 4 AS route_id", "lang AS path", "(doc_id % 8) / 8D AS confidence"))
    sure = F.transform("consumers", lambda c: c["confidence"])
    return found.select("id", F.size("consumers").cast("long").alias("files"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("best"), F.aggregate(sure, F.lit(0.0), lambda a, x: a + x).alias("total"))


# Each document ends in a snippet of one of five languages that provides a route and a service.
_SNIPPETS = {
    "go": ("go", 'mux.HandleFunc("/d/#", h#)\npb.RegisterS#Server(s, x)', "ANY", "h#", "RegisterS#Server"),
    "py": ("python", '\n@app.route("/d/#", methods=["PUT"])\n@wrapped\ndef h#(x):\n  p.add_S#Servicer_to_server(x)', "PUT", "h#", "add_S#Servicer_to_server"),
    "ts": ("node", "app.get('/d/#', (q, s) => 1)\nserver.addService(p.S#.service, {})", "GET", "<unknown>", "addService::S#"),
    "java": ("java", '@PostMapping("/d/#") public String h#() {}\n.addService(new A.S#ImplBase() {})', "POST", "h#", "addService::S#ImplBase"),
    "rs": ("rust", '.route("/d/#", delete(h#))\n.add_service(pb::x::S#Server::new(a))', "DELETE", "h#", "add_service::S#Server"),
}
_CONTRACTS = " UNION ALL ".join(
    f"""SELECT source AS repo, replace(id, '#', doc_id::VARCHAR) AS contract_id, 'd' || doc_id || '.{ending}::' || replace(symbol, '#', doc_id::VARCHAR) AS symbol, sure::DOUBLE AS confidence
FROM documents, (VALUES ('http:{verb}:/d/#', '{handler}', 0.85), ('grpc:S#:*', '{service}', 0.9)) AS c(id, symbol, sure) WHERE doc_id % 5 = {k}"""
    for k, (ending, (_, _, verb, handler, service)) in enumerate(_SNIPPETS.items())
)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippet = F.get(F.array(*(F.lit(s[1]) for s in _SNIPPETS.values())), (F.col("doc_id") % 5).cast("int"))
    ending = F.get(F.array(*map(F.lit, _SNIPPETS)), (F.col("doc_id") % 5).cast("int"))
    number = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit("\n"), F.replace(snippet, F.lit("#"), number))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("d"), number, F.lit("."), ending).alias("path"), text.alias("text"))


@query(_CONTRACTS)
def extracted_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and services that the documents provide."""
    return contracts.extracted(_sources(spark, sf_dir)).select("repo", "contract_id", "symbol", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query(f"""WITH p AS ({_CONTRACTS}) SELECT 'web' AS c_repo, 'c' || page_id AS c_symbol, p.repo AS p_repo, p.symbol AS p_symbol, 'exact' AS match_type FROM pages JOIN p ON p.contract_id = 'http:ANY:/d/' || page_id""")
def group_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact links from pages that fetch a route to the documents that provide it, read back from the stored registry."""
    files = _sources(spark, sf_dir)
    asked = table(spark, sf_dir, "pages").selectExpr("'web' AS repo", "concat('http:ANY:/d/', page_id) AS contract_id", "'http' AS contract_type", "'consumer' AS role", "concat('c', page_id) AS symbol", "url AS file_path", "'f' AS symbol_name", "CAST(0.8 AS FLOAT) AS confidence", "map('method', 'ANY') AS meta")
    _, links, _ = contracts.synced(files, files.select("repo").distinct(), folder(spark, "group"), asked, exact_only=True)
    return links.select("c_repo", "c_symbol", "p_repo", "p_symbol", "match_type")


# --- fetches and answers

# Each document ends in a script that fetches by its number and language, or answers with its number as a key.
_FETCHING = """const { a#, b: c } = await res.json(); x = data?.k# + data.map(f);
fetch("/f/#"); fetch('/f/#', { cache: 1, method: 'put' }); fetch(`/g/#`); axios.post("/x/$LANG"); requests.get('/y')"""
_ANSWERING = """res.status(200).json({ k#, nested: { no: 1 }, "$LANG": f(x) }); if (e) return Response.json({ error: "{ z }" }, { status: 404 })"""
_PHP = """http_response_code(500); echo json_encode(['k#' => ['no' => 1], "$LANG" => 2]); exit; echo json_encode(array('ok' => 1));"""


def _scripts(spark: SparkSession, sf_dir: str, *snippets: str) -> DataFrame:
    n = len(snippets)
    snippet = F.get(F.array(*map(F.lit, snippets)), (F.col("doc_id") % n).cast("int"))
    filled = F.replace(F.replace(snippet, F.lit("#"), F.col("doc_id").cast("string")), F.lit("$LANG"), F.col("lang"))
    language = F.when(F.col("doc_id") % n == 0, "typescript").otherwise("php")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), language.alias("language"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), filled).alias("text"))


@query("""SELECT doc_id AS file_id, replace(method, '$', '') AS method, replace(replace(url, '#', doc_id::VARCHAR), '$', lang) AS url, ['a' || doc_id, 'b', 'k' || doc_id] AS keys
FROM documents, (VALUES ('PUT', '/f/#'), ('GET', '/g/#'), ('POST', '/x/$'), ('GET', '/y')) AS c(method, url)""")
def fetching_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.consumers(_scripts(spark, sf_dir, _FETCHING))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN list_sort(['k' || doc_id, 'nested', lang]) ELSE ['ok'] END AS response_keys, CASE WHEN doc_id % 2 = 0 THEN ['error'] ELSE list_sort(['k' || doc_id, lang]) END AS error_keys FROM documents""")
def answering_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.answers(_scripts(spark, sf_dir, _ANSWERING, _PHP))


# --- differences


@query("""WITH r AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_size = 50 UNION SELECT DISTINCT p_brand FROM part WHERE p_partkey % 97 = 0)
SELECT p_brand AS path, p_size AS start_row, p_type AS kind, p_name AS hint FROM part JOIN r ON r.path = p_brand WHERE p_partkey % 4 <> 0""")
def blind_spots_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind spots in files that came, or of which a symbol changed; those of tests and of no known test are told apart."""
    part = table(spark, sf_dir, "part")
    region = diff.region(part.where("p_size = 50").selectExpr("p_brand AS path"), part.where("p_partkey % 97 = 0").selectExpr("p_brand AS path"))
    return diff.spots_in_region(part.selectExpr("p_brand AS file_path", "p_size AS start_row", "p_type AS kind", "p_name AS hint", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_test"), region)


@query("""SELECT l_orderkey AS change, CASE WHEN bool_and(s = 0) THEN 'cli' WHEN bool_and(s = 1) THEN 'docs' END AS area FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN 0 WHEN l_suppkey % 3 = 1 THEN 1 ELSE 2 END AS s FROM lineitem) GROUP BY 1""")
def change_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS change", "concat(CASE l_suppkey % 3 WHEN 0 THEN 'src/cli/' WHEN 1 THEN 'docs/' ELSE 'lib/' END, l_partkey) AS path")
    return detect.areas(paths, "change", "path", {"^src/cli/": "cli", "^docs/|[.]md$": "docs"})


# --- the inbox


@query("""SELECT user_id AS peer, 'k' || user_id % 10 AS name, CASE WHEN user_id % 10 < 2 THEN 'HARD' ELSE 'SOFT' END AS concern, count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND user_id % 10 IN (0, 1, 3, 4) GROUP BY ALL""")
def inbox_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as dirty events of peers; a name that is dirty here and in the impact set too is HARD."""
    events = table(spark, sf_dir, "events").selectExpr("ts", "CAST(user_id AS STRING) AS peer_session", "IF(event_type IN ('view', 'click'), 'dirty_event', 'message') AS type", "named_struct('name', concat('k', user_id % 10)) AS symbol")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    found = inbox.concerns(events, names("k0", "k1"), names("k1", "k3", "k4"))
    return found.groupBy(F.col("peer_session").cast("long").alias("peer"), "name", "concern").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' AND (user_id = 7 OR event_id = 7)")
def inbox_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr("event_id AS id", "IF(event_type = 'view', 'message', 'dirty_event') AS type", "CAST(event_id AS STRING) AS msg_id", "CAST(user_id AS STRING) AS reply_to")
    return inbox.thread(log, "7").select("id")
