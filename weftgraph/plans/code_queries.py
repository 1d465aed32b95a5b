"""Registered queries of the code-graph operators, with rows of the driver's tables in the parts of symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import derive, detect, diff, processes
from weftgraph.plans import model
from weftgraph.sources.commerce import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function as a query of its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*columns)


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*columns)


_FLAGS = [(r, r in model.CODE.heuristic, r not in model.CODE.containment) for r in model.REL_TYPES]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', {h}, {i})" for r, h, i in _FLAGS) + ") AS t(rel_type, heuristic, in_impact)")
def schema_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_FLAGS, "rel_type string, heuristic boolean, in_impact boolean")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in model.NODE_KINDS) + ") AS t(kind)")
def schema_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in model.NODE_KINDS], "kind string")


@query("""WITH m AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, CASE WHEN p_size % 8 = 0 THEN 0.9 ELSE 0.5 END AS confidence FROM part WHERE p_size % 4 = 0)
SELECT a.p_name AS topic, b.p_name AS mirror, (SELECT arg_min(l_suppkey, l_orderkey * 100000 + l_suppkey) FROM lineitem WHERE l_partkey = m.src) AS publisher, (SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = m.dst) AS subscriber, confidence::DOUBLE AS confidence
FROM m JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_name LIKE 'small %' AND confidence >= 0.8""")
def event_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_name AS name")
    mirrors = parts(spark, sf_dir, "p_partkey AS edge_id", "p_partkey AS src", "p_partkey + 1 AS dst", "'EventTopicMirror' AS rel_type", "IF(p_size % 8 = 0, 0.9D, 0.5D) AS confidence").join(parts(spark, sf_dir, "p_partkey AS edge_id", "p_size").where("p_size % 4 = 0"), "edge_id", "left_semi")
    lines = table(spark, sf_dir, "lineitem")
    out = lines.selectExpr("l_orderkey * 100000 + l_suppkey AS edge_id", "l_suppkey AS src", "l_partkey AS dst", "'Publishes' AS rel_type", "1.0D AS confidence")
    into = lines.selectExpr("l_orderkey AS edge_id", "l_orderkey AS src", "l_partkey AS dst", "'Subscribes' AS rel_type", "1.0D AS confidence")
    return detect.event_mirrors(nodes, mirrors.unionByName(out).unionByName(into), "small *", 0.8)


@query("SELECT a.p_name AS action, b.p_name AS compensation, a.p_size / 50.0::DOUBLE AS confidence, CASE WHEN a.p_size / 50.0 >= 0.75 THEN 'strong' ELSE 'weak' END AS tier FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand = 'Brand#5'")
def saga_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_name AS name", "p_brand AS owner_class")
    return detect.saga_list(nodes, parts(spark, sf_dir, "p_partkey AS src", "p_partkey + 1 AS dst", "'CompensatedBy' AS rel_type", "p_size / 50.0D AS confidence"), "Brand#5")


@query("""SELECT t.p_partkey AS table_id, w.p_partkey AS writer_id, p.p_partkey AS publisher_id, 0.8::DOUBLE AS confidence
FROM part t, part w JOIN part p ON p.p_partkey BETWEEN w.p_partkey AND w.p_partkey + 5 WHERE t.p_partkey % 500 = 0 AND w.p_size = 7 AND p.p_size = 3""")
def outbox_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "IF(p_partkey % 500 = 0, 'outbox_events', p_name) AS name", "IF(p_size = 7, 'outbox_events', NULL) AS owner_class")
    calls = parts(spark, sf_dir, "p_partkey AS edge_id", "p_partkey AS src", "p_partkey + 1 AS dst", "'Calls' AS rel_type")
    publishes = table(spark, sf_dir, "part").where("p_size = 3").selectExpr("p_partkey AS edge_id", "p_partkey AS src", "p_partkey AS dst", "'Publishes' AS rel_type")
    return detect.outbox(nodes, calls.unionByName(publishes))


@query("SELECT p_brand AS id, CASE p_size % 3 WHEN 0 THEN 'methods' WHEN 1 THEN 'properties' ELSE 'variants' END AS bucket, count(*) AS n FROM part GROUP BY 1, 2")
def contained_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "CASE p_size % 3 WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' ELSE 'EnumVariant' END AS kind")
    return detect.members(nodes, parts(spark, sf_dir, "p_brand AS src", "p_partkey AS dst", "CASE p_size % 3 WHEN 0 THEN 'HasMethod' WHEN 1 THEN 'HasProperty' ELSE 'Defines' END AS rel_type"))


@query("SELECT lang AS kind, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY 1")
def blind_spot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.blind_spots(docs(spark, sf_dir, "lang AS kind"), ("fr",))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 2 AND bool_and(p_size <= 48)")
def unmirrored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = table(spark, sf_dir, "part").where("p_size > 48").selectExpr("p_partkey AS src", "p_partkey AS dst", "'MirrorsField' AS rel_type")
    return detect.unmirrored(parts(spark, sf_dir, "p_partkey AS id", "p_name AS name"), tied)


@query("""SELECT l_partkey AS src, l_suppkey AS dst, max(1 - l_discount) AS confidence, CASE WHEN max(1 - l_discount) >= 0.95 THEN 'strong' ELSE 'weak' END AS tier FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey GROUP BY 1, 2""")
def schema_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS src", "l_suppkey AS dst", "'MirrorsField' AS rel_type", "1 - l_discount AS confidence")
    return detect.schema_bindings(parts(spark, sf_dir, "p_partkey AS id", "p_name AS name"), pairs, 0.95).select("src", "dst", "confidence", "tier")


@query("""WITH k AS (SELECT p_name AS name, CASE WHEN p_size % 9 = 0 THEN 'Class' WHEN p_size % 2 = 0 THEN 'Impl' ELSE 'Function' END AS kind, p_partkey AS id FROM part),
t AS (SELECT name, bool_or(kind = 'Class') AS typed, count(*) FILTER (kind = 'Impl') AS impls FROM k GROUP BY 1)
SELECT id, kind, CASE WHEN typed THEN impls ELSE 0 END AS suppressed FROM k JOIN t USING (name) WHERE NOT (typed AND kind = 'Impl')""")
def impl_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_name AS name", "CASE WHEN p_size % 9 = 0 THEN 'Class' WHEN p_size % 2 = 0 THEN 'Impl' ELSE 'Function' END AS kind")
    return detect.without_impls(nodes).select("id", "kind", "suppressed")


@query(r"""WITH l AS (SELECT doc_id, lang, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id AS file_id, line + 1 AS line, CASE lang WHEN 'de' THEN 'test' WHEN 'fr' THEN 'markdown' WHEN 'es' THEN 'data' ELSE 'code' END AS context FROM l WHERE regexp_matches(t, '(^|[^\p{L}\p{M}\p{Nd}_])License($|[^\p{L}\p{M}\p{Nd}_])')""")
def rename_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat(source, CASE lang WHEN 'de' THEN '/tests/a.py' WHEN 'fr' THEN '/a.md' WHEN 'es' THEN '/a.yml' ELSE '/a.py' END)")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return detect.mentions(lines, "License").select("file_id", (F.col("line") + 1).cast("long").alias("line"), "context")


_PATHS = "source || '/' || lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '_test.go' WHEN 1 THEN '.ts' WHEN 2 THEN 'Test.java' ELSE '/Dockerfile' END"


@query(f"SELECT doc_id AS id, {_PATHS} AS path FROM documents WHERE {_PATHS} LIKE '%/Dockerfile' ORDER BY path LIMIT 1")
def file_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.file_by_suffix(docs(spark, sf_dir, "doc_id AS id", f"{_PATHS} AS path"), "/Dockerfile")


@query("""SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'Reference' WHEN lang = 'fr' THEN 'Example' WHEN doc_id % 4 IN (0, 2) THEN 'Test' WHEN doc_id % 4 = 1 THEN 'Source' ELSE 'Config' END AS category FROM documents""")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "doc_id AS id", f"concat(CASE lang WHEN 'de' THEN 'Vendor/' WHEN 'fr' THEN 'a/demos/' ELSE 'manifest/' END, {_PATHS}) AS path").select("id", X.file_category(F.col("path")).alias("category"))


# --- derived edges


@query("""WITH s AS (SELECT conv_id, conv_id * 1000 + turn AS id, role, turn * 10 AS a, turn * 10 + CASE WHEN role = 'user' THEN 25 ELSE 3 END AS b FROM conversations)
SELECT arg_min(t.id, struct_pack(w := t.b - t.a, i := t.id)) AS src, p.id AS dst, 'HasMethod' AS rel_type FROM s p JOIN s t ON t.conv_id = p.conv_id AND t.role = 'user' AND p.role = 'assistant' AND t.a <= p.a AND t.b >= p.b GROUP BY p.id""")
def class_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "conversations").selectExpr("conv_id AS file_id", "conv_id * 1000 + turn AS id", "text AS name", "CASE role WHEN 'user' THEN 'Class' WHEN 'assistant' THEN 'Method' ELSE 'Document' END AS kind", "CAST(NULL AS STRING) AS owner_class", "turn * 10 AS start_row", "turn * 10 + IF(role = 'user', 25, 3) AS end_row")
    return derive.membership(nodes)


@query("SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_brand = 'Brand#' || (CAST(replace(a.p_brand, 'Brand#', '') AS INTEGER) + 1)")
def method_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    heritage = parts(spark, sf_dir, "p_brand AS owner", "concat('Brand#', CAST(replace(p_brand, 'Brand#', '') AS INT) + 1) AS parent").distinct()
    return derive.overrides(parts(spark, sf_dir, "p_partkey AS id", "p_brand AS owner", "p_name AS name"), heritage)


@query("SELECT p_partkey AS dst, p_type AS name, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM part")
def decorator_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(1, "SMALL"), (2, "ECONOMY")], "id long, name string")
    return derive.decorates(parts(spark, sf_dir, "p_partkey AS id", "concat('@', p_type, '(x)') AS decorator"), types).select("dst", "name", "confidence")


@query("""WITH m AS (SELECT p_partkey AS id, p_brand AS owner, replace(p_name, ' ', '') AS k, p_size % 2 = 0 AND p_size % 3 > 0 AS undo, p_size % 2 = 0 AND p_size % 3 = 0 AS other FROM part)
SELECT a.id AS src, b.id AS dst, CASE WHEN a.id % 2 = 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM m a JOIN m b ON a.owner = b.owner AND a.k = b.k AND NOT a.undo AND NOT a.other AND b.undo""")
def saga_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = parts(spark, sf_dir, "p_partkey AS id", "p_brand AS owner", "concat(IF(p_size % 2 = 0, CASE p_size % 3 WHEN 0 THEN 'undo' WHEN 1 THEN 'undo_' ELSE 'RollBack_' END, ''), replace(p_name, ' ', '')) AS name")
    pairs = methods.selectExpr("id AS dst", "owner", "regexp_replace(name, '^(undo|RollBack)_', '') AS k", "rlike(name, '^(undo|RollBack)_') AS u").where("u").join(methods.selectExpr("id AS src", "owner", "name AS k"), ["owner", "k"])
    return derive.saga_pairs(methods, pairs.where("src % 2 = 0").selectExpr("dst AS src", "src AS dst"))


@query("SELECT doc_id AS src, lang AS dst, 'read' AS reason FROM documents UNION ALL SELECT doc_id, source, 'write' FROM documents")
def sql_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = docs(spark, sf_dir, "doc_id AS id", "concat('INSERT INTO ', source, ' SELECT a, b FROM app.', upper(lang), ' JOIN nowhere ON true') AS sql")
    known = docs(spark, sf_dir, "lang AS id", "lang AS name").union(docs(spark, sf_dir, "source AS id", "source AS name")).distinct()
    return derive.table_refs(asked, known)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'read' WHEN doc_id % 3 = 1 THEN 'write' ELSE 'unknown' END AS access, CASE WHEN doc_id % 3 = 2 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM documents WHERE doc_id % 2 = 0")
def path_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = docs(spark, sf_dir, "doc_id AS id", "IF(doc_id % 2 = 0, concat(source, '/', lang, '.json'), lang) AS text", "CASE doc_id % 3 WHEN 0 THEN 'fs.open' WHEN 1 THEN 'out.write' ELSE 'print' END AS callee")
    return derive.path_literals(literals).select("id", "access", F.col("confidence").cast("double").alias("confidence"))


@query("""WITH e AS (SELECT doc_id AS id, 'route' AS source, 1.0 AS c FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'main', 0.9 FROM documents WHERE doc_id % 15 = 0 UNION ALL SELECT doc_id, 'framework', (n_chars % 100) / 100.0 FROM documents WHERE doc_id % 4 = 0 AND n_chars % 100 >= 80)
SELECT id, source, c::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, source) AS r FROM e) WHERE r = 1""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return derive.entry_points(d.where("doc_id % 10 = 0").selectExpr("doc_id AS id"), d.where("doc_id % 15 = 0").selectExpr("doc_id AS id"), d.where("doc_id % 4 = 0").selectExpr("doc_id AS id", "(n_chars % 100) / 100D AS confidence"))


@query("""SELECT d.doc_id AS import_id, CASE WHEN p.id IS NOT NULL THEN p.id ELSE 1000000 + CASE WHEN d.doc_id % 4 = 3 THEN 4 ELSE 0 END + l.k END AS dst, CASE WHEN p.id IS NOT NULL THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence
FROM documents d JOIN (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) AS l(lang, k) USING (lang)
LEFT JOIN (SELECT p_partkey AS id FROM part) p ON p.id = d.doc_id // 2 AND d.doc_id % 2 = 0""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents import a part by its name, where there is one; others, by ending, last segment, crate or folder."""
    specifier = "CASE doc_id % 4 WHEN 0 THEN concat('<', lang, '/mod.py>') WHEN 1 THEN concat('crate::x::', lang, '_top') WHEN 2 THEN concat('host/', lang, '_top') ELSE concat(upper(lang), 'Dir') END"
    imports = docs(spark, sf_dir, "doc_id AS import_id", "concat(source, '/m.py') AS path", f"{specifier} AS specifier", "IF(doc_id % 2 = 0, concat('org.n', doc_id DIV 2), 'none') AS name")
    langs = spark.createDataFrame([(x, k) for k, x in enumerate(("en", "de", "fr", "es"))], "lang string, k long")
    # ``mod.py`` stands under a search path; a ``_top.py`` has the same node, so that both specifiers mean it.
    files = langs.selectExpr("concat('inc/', lang, '/mod.py') AS path", "1000000 + k AS node_id")
    files = files.unionByName(langs.selectExpr("concat('lib/', lang, '_top.py') AS path", "1000000 + k AS node_id"))
    files = files.unionByName(langs.selectExpr("concat('lib/', upper(lang), 'Dir/one.py') AS path", "1000004 + k AS node_id")).unionByName(langs.selectExpr("concat('lib/', upper(lang), 'Dir/one.cs') AS path", "5 AS node_id"))
    return derive.import_edges(imports, parts(spark, sf_dir, "p_partkey AS id", "concat('n', p_partkey) AS name"), files).select("import_id", "dst", F.col("confidence").cast("double").alias("confidence"))


@query("""WITH f AS (SELECT conv_id, min(CASE WHEN role = 'system' THEN conv_id * 1000 + turn + 1 END) AS space FROM conversations GROUP BY 1)
SELECT CASE WHEN turn % 2 = 0 THEN space ELSE conv_id END AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations JOIN f USING (conv_id) WHERE CASE WHEN role = 'system' THEN turn % 2 = 1 OR space IS NOT NULL WHEN role = 'user' THEN turn % 2 = 1 OR space IS NOT NULL ELSE FALSE END""")
def scope_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns are namespaces, all of one name; user turns functions; assistant turns properties. Even turns lie in the namespace."""
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.selectExpr("conv_id * 1000 + turn + 1 AS id", "conv_id AS file_id", "IF(role = 'system', 'space', text) AS name", "CASE role WHEN 'system' THEN 'Namespace' WHEN 'user' THEN 'Function' ELSE 'Property' END AS kind", "IF(turn % 2 = 0, 'space', NULL) AS owner_class")
    return derive.scope_defines(nodes.unionByName(turns.selectExpr("conv_id AS id", "conv_id AS file_id", "'' AS name", "'File' AS kind", "CAST(NULL AS STRING) AS owner_class").distinct()))


@query("SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_name = b.p_name AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1")
def enum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.enum_variants(parts(spark, sf_dir, "p_partkey AS id", "p_size AS file_id", "p_name AS name", "p_name AS owner_class", "IF(p_partkey % 2 = 0, 'Enum', 'EnumVariant') AS kind"))


@query("SELECT p_partkey AS src, 'OpensTxScope' AS rel_type FROM part WHERE p_size % 5 = 0")
def transaction_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.transaction_scopes(parts(spark, sf_dir, "p_partkey AS id", "IF(p_size % 5 = 0, array('@db.Transactional(a)'), array('@cached', 'transactions_log')) AS decorators")).select("src", "rel_type")


@query("SELECT a.p_partkey AS src, b.p_partkey AS dst, CASE WHEN b.p_size % 2 = 0 THEN 'Implements' ELSE 'Extends' END AS rel_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def heritage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.heritage_edges(parts(spark, sf_dir, "p_partkey AS src", "p_partkey + 1 AS dst"), parts(spark, sf_dir, "p_partkey AS id", "IF(p_size % 2 = 0, 'Interface', 'Class') AS kind"))


@query("SELECT conv_id * 1000 + turn AS src, conv_id AS dst, 'step:' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS reason FROM conversations")
def process_step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("process_id")).agg(F.array_sort(F.collect_list(F.col("conv_id") * 1000 + F.col("turn"))).alias("steps"))
    return processes.step_edges(stored).select("src", "dst", "reason")


@query("""SELECT conv_id AS entry, CASE WHEN count(DISTINCT CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END) > 1 THEN 'cross' ELSE 'intra' END AS process_type FROM conversations GROUP BY 1""")
def process_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id * 1000 + turn AS id", "CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS community_id")
    found = turns.groupBy(F.col("conv_id").alias("entry")).agg(F.max("id").alias("terminal"), F.array_sort(F.collect_list("id")).alias("steps"))
    return processes.process_type(found, turns.select("id", "community_id")).select("entry", "process_type")


# --- differences


_ROUTES = ("o_orderpriority AS method", "o_orderkey AS path", "o_orderstatus AS file")


@query("""WITH o AS (SELECT o_orderpriority AS method, o_orderkey AS path, o_orderstatus AS f, o_custkey AS l FROM orders WHERE o_orderkey % 13 <> 0), n AS (SELECT o_orderpriority AS method, o_orderkey AS path, o_orderstatus AS f, o_custkey + (o_orderkey % 5 = 0)::INT AS l FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT method, path, CASE WHEN o.f IS NULL THEN 'added' WHEN n.f IS NULL THEN 'removed' ELSE 'changed' END AS status FROM o FULL JOIN n USING (method, path) WHERE o.l IS DISTINCT FROM n.l)
SELECT method, path, status, CASE WHEN status = 'removed' THEN 'Risk' WHEN status = 'changed' THEN CASE WHEN path % 3 > 0 THEN 'Risk' ELSE 'Warn' END ELSE 'Info' END AS verdict FROM d""")
def route_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    changed = diff.routes(orders.where("o_orderkey % 13 <> 0").selectExpr(*_ROUTES, "o_custkey AS line"), orders.where("o_orderkey % 11 <> 0").selectExpr(*_ROUTES, "o_custkey + IF(o_orderkey % 5 = 0, 1, 0) AS line"))
    return diff.route_verdicts(changed.withColumn("consumers", F.col("path") % 3)).drop("consumers")


@query("""SELECT b.p_partkey AS id, count(*) FILTER (a.p_size = b.p_size) AS intra, count(*) FILTER (a.p_size <> b.p_size) AS "cross", min(1 - l_discount) AS min_confidence FROM lineitem JOIN part a ON a.p_partkey = l_suppkey JOIN part b ON b.p_partkey = l_partkey WHERE b.p_size % 10 = 0 GROUP BY 1""")
def callers_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_size AS file_id")
    calls = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS src", "l_partkey AS dst", "'Calls' AS rel_type", "1 - l_discount AS confidence")
    return diff.callers(nodes.where("file_id % 10 = 0"), nodes, calls)


@query("SELECT p_partkey AS edge_id, CASE WHEN p_size % 2 = 0 THEN 'dynamic_dispatch' ELSE 'callback' END AS dispatch FROM part WHERE p_size % 6 IN (0, 2, 3, 4) AND p_size > 30 AND p_partkey % 7 <> 0")
def indirect_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = parts(spark, sf_dir, "p_partkey AS edge_id", "p_size % 2 = 0 AS is_dynamic_dispatch", "p_size % 3 = 0 AS is_callback")
    nodes = parts(spark, sf_dir, "p_partkey AS id", "p_size AS file_id")
    return diff.indirect_in_region(meta, parts(spark, sf_dir, "p_partkey AS edge_id", "p_partkey AS src"), nodes, nodes.where("file_id > 30").select("file_id").distinct(), parts(spark, sf_dir, "p_partkey AS node_id", "p_partkey % 7 = 0 AS is_test"))


@query("SELECT p_partkey AS path FROM part WHERE p_partkey % 3 = 0 OR p_size % 2 = 0")
def overlay_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay = parts(spark, sf_dir, "p_partkey AS path", "p_size AS hash")
    base = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("p_partkey AS path", "p_size + IF(p_size % 2 = 0, 1, 0) AS hash")
    return diff.promoted(overlay, base).select("path")


@query("""WITH f AS (SELECT DISTINCT source || '/m' || (doc_id % 40) AS stem, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.js' END AS tail FROM documents)
SELECT a.stem || a.tail AS path, b.stem || b.tail AS shadows FROM f a JOIN f b USING (stem) WHERE a.tail = '.ts' AND b.tail <> '.ts'""")
def import_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir, "concat(source, '/m', doc_id % 40, CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.js' END) AS path").distinct()
    return diff.shadowed(files.where(F.col("path").endswith(".ts")), files)


@query("SELECT source AS repo, doc_id AS built_no FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 3")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.latest(docs(spark, sf_dir, "source AS repo", "doc_id AS built_no"), 3)


@query("SELECT 'impact' AS section, p_brand AS path, 'info' AS severity, p_name || ' has ' || count(*) || ' callers' AS detail FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_name HAVING count(*) >= 4")
def impact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").join(parts(spark, sf_dir, "p_partkey AS l_partkey", "p_brand AS path", "p_name AS name"), "l_partkey").groupBy("path", "name").agg(F.count(F.lit(1)).alias("callers"))
    return diff.findings(diff.impact_findings(counts))
