"""Registered queries in the graph query language over the commerce profile, each with SQL for the same rows."""

from __future__ import annotations

from weftgraph.cypher import run
from weftgraph.sources import commerce

# name: (query, SQL after the common table expressions nodes and edges)
_CASES = {
    "cypher_flagship": (
        "MATCH (c:Customer)-[p:PLACED]->(o:Order) RETURN c.name AS name, count(p) AS orders ORDER BY orders DESC, name LIMIT 20",
        "SELECT n.name AS name, count(*) AS orders FROM nodes n JOIN edges e ON e.src = n.id AND e.rel_type = 'PLACED' WHERE n.kind = 'Customer' GROUP BY n.id, n.name ORDER BY orders DESC, name LIMIT 20",
    ),
    "cypher_scan_all": ("MATCH (n) RETURN n.kind AS kind, count(*) AS n", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind"),
    "cypher_scan_labels": ("MATCH (n:Region|Nation) RETURN n.name AS name, n.kind AS kind", "SELECT name, kind FROM nodes WHERE kind IN ('Region', 'Nation')"),
    "cypher_inline_property": ("MATCH (n:Nation {name: 'NATION_3'})-[:IN_REGION]->(r) RETURN r.name AS region", "SELECT r.name AS region FROM nodes n JOIN edges e ON e.src = n.id AND e.rel_type = 'IN_REGION' JOIN nodes r ON r.id = e.dst WHERE n.name = 'NATION_3'"),
    "cypher_expand_in": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, count(*) AS nations", "SELECT r.name AS region, count(*) AS nations FROM nodes r JOIN edges e ON e.dst = r.id AND e.rel_type = 'IN_REGION' GROUP BY r.name"),
    "cypher_expand_both": ("MATCH (n:Nation)-[e]-(m) RETURN n.name AS name, type(e) AS rel, count(*) AS n", "SELECT name, rel, count(*) AS n FROM (SELECT n.name, e.rel_type AS rel FROM nodes n JOIN edges e ON e.src = n.id WHERE n.kind = 'Nation' UNION ALL SELECT n.name, e.rel_type FROM nodes n JOIN edges e ON e.dst = n.id WHERE n.kind = 'Nation') GROUP BY name, rel"),
    "cypher_relation_alternatives": ("MATCH (a)-[e:in_region|InNation]->(b) RETURN e.rel_type AS rel, count(*) AS n", "SELECT rel_type AS rel, count(*) AS n FROM edges WHERE rel_type IN ('IN_REGION', 'IN_NATION') GROUP BY rel_type"),
    "cypher_variable_length": (
        "MATCH (r:Region)<-[:IN_REGION|IN_NATION*1..2]-(x) RETURN r.name AS region, x.kind AS kind, count(*) AS n",
        "SELECT region, kind, count(*) AS n FROM (SELECT r.name AS region, n.kind FROM nodes r JOIN edges e ON e.dst = r.id AND e.rel_type = 'IN_REGION' JOIN nodes n ON n.id = e.src UNION ALL SELECT r.name, m.kind FROM nodes r JOIN edges e ON e.dst = r.id AND e.rel_type = 'IN_REGION' JOIN edges f ON f.dst = e.src AND f.rel_type = 'IN_NATION' JOIN nodes m ON m.id = f.src) GROUP BY region, kind",
    ),
    "cypher_exact_length": ("MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION|IN_NATION*2]-(x:Supplier) RETURN x.name AS name", "SELECT m.name AS name FROM nodes r JOIN edges e ON e.dst = r.id AND e.rel_type = 'IN_REGION' JOIN edges f ON f.dst = e.src AND f.rel_type = 'IN_NATION' JOIN nodes m ON m.id = f.src WHERE r.name = 'ASIA' AND m.kind = 'Supplier'"),
    "cypher_chain": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE c.amount > 9000 RETURN c.name AS name, count(*) AS n, min(l.confidence) AS low", "SELECT c.name AS name, count(*) AS n, min(l.confidence) AS low FROM nodes c JOIN edges e ON e.src = c.id AND e.rel_type = 'PLACED' JOIN edges l ON l.src = e.dst AND l.rel_type = 'CONTAINS' WHERE c.kind = 'Customer' AND c.amount > 9000 GROUP BY c.name"),
    "cypher_correlated_match": ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) MATCH (n)-[:IN_REGION]->(r:Region) RETURN s.name AS supplier, r.name AS region", "SELECT s.name AS supplier, r.name AS region FROM nodes s JOIN edges e ON e.src = s.id AND e.rel_type = 'IN_NATION' JOIN edges f ON f.src = e.dst AND f.rel_type = 'IN_REGION' JOIN nodes r ON r.id = f.dst WHERE s.kind = 'Supplier'"),
    "cypher_comma_patterns": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, b.name AS b", "SELECT name AS a, NULL::VARCHAR AS b FROM nodes WHERE kind = 'Region' UNION ALL SELECT NULL, name FROM nodes WHERE kind = 'Nation'"),
    "cypher_optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[p:PLACED]->(o:Order) RETURN c.name AS name, count(o.name) AS n", "SELECT c.name AS name, count(e.edge_id) AS n FROM nodes c LEFT JOIN edges e ON e.src = c.id AND e.rel_type = 'PLACED' WHERE c.kind = 'Customer' GROUP BY c.name"),
    "cypher_where_logic": ("MATCH (p:Part) WHERE p.amount >= 950 AND NOT (p.is_test = true OR p.name CONTAINS '7') RETURN p.name AS name, p.amount AS amount", "SELECT name, amount FROM nodes WHERE kind = 'Part' AND amount >= 950 AND NOT (is_test OR contains(name, '7'))"),
    "cypher_null_logic": ("MATCH (n:Region) WHERE n.owner_class = null AND NOT n.owner_class = 'x' RETURN n.name AS name", "SELECT name FROM nodes WHERE kind = 'Region'"),
    "cypher_in_list": ("MATCH (n:Nation) WHERE n.name IN ['NATION_1', 'NATION_5', null] RETURN n.name AS name", "SELECT name FROM nodes WHERE kind = 'Nation' AND name IN ('NATION_1', 'NATION_5')"),
    "cypher_in_property": ("MATCH (p:Part) WHERE 'STEEL' IN p.decorators OR 'BRASS' IN p.decorators RETURN count(*) AS n", "SELECT count(*) AS n FROM nodes WHERE kind = 'Part' AND (list_contains(decorators, 'STEEL') OR list_contains(decorators, 'BRASS'))"),
    "cypher_regex": ("MATCH (o:Order) WHERE o.name =~ '_1[0-4]+$' RETURN o.name AS name", "SELECT name FROM nodes WHERE kind = 'Order' AND regexp_matches(name, '_1[0-4]+$')"),
    "cypher_string_tests": ("MATCH (c:Customer) WHERE c.name ENDS WITH '99' AND c.name STARTS WITH 'C' RETURN c.name AS name", "SELECT name FROM nodes WHERE kind = 'Customer' AND name LIKE 'C%99'"),
    "cypher_label_test": ("MATCH (n) WHERE n:Region|Nation RETURN n.name AS name, labels(n) AS labels", "SELECT name, [kind] AS labels FROM nodes WHERE kind IN ('Region', 'Nation')"),
    "cypher_edge_properties": ("MATCH (o:Order)-[l:CONTAINS]->(p) WHERE l.confidence < 0.91 AND l.reason = 'R' RETURN o.name AS name, l.confidence AS confidence, l.reason AS reason", "SELECT o.name, e.confidence, e.reason FROM nodes o JOIN edges e ON e.src = o.id AND e.rel_type = 'CONTAINS' WHERE e.confidence < 0.91 AND e.reason = 'R'"),
    "cypher_ids": ("MATCH (r:Region)<-[e]-(n) RETURN id(r) AS region_id, id(n) AS nation_id, type(e) AS rel", "SELECT dst AS region_id, src AS nation_id, rel_type AS rel FROM edges WHERE rel_type = 'IN_REGION'"),
    "cypher_aggregates": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS n, count(DISTINCT c.name) AS names, sum(c.amount) AS total, avg(c.amount) AS mean, min(c.amount) AS low, max(c.amount) AS high",
        "SELECT n.name AS nation, count(*) AS n, count(DISTINCT c.name) AS names, sum(c.amount) AS total, avg(c.amount) AS mean, min(c.amount) AS low, max(c.amount) AS high FROM nodes c JOIN edges e ON e.src = c.id AND e.rel_type = 'IN_NATION' JOIN nodes n ON n.id = e.dst WHERE c.kind = 'Customer' GROUP BY n.name",
    ),
    "cypher_collect": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, collect(n.name) AS nations", "SELECT r.name AS region, list(n.name ORDER BY n.id) AS nations FROM nodes r JOIN edges e ON e.dst = r.id AND e.rel_type = 'IN_REGION' JOIN nodes n ON n.id = e.src GROUP BY r.name"),
    "cypher_with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n, sum(o.amount) AS total WHERE n >= 20 RETURN c.name AS name, n AS n, total AS total", "SELECT c.name AS name, count(*) AS n, sum(o.amount) AS total FROM nodes c JOIN edges e ON e.src = c.id AND e.rel_type = 'PLACED' JOIN nodes o ON o.id = e.dst GROUP BY c.id, c.name HAVING count(*) >= 20"),
    "cypher_with_projection": ("MATCH (p:Part) WITH p, p.amount AS price WHERE price > 990 RETURN p.name AS name, price AS price", "SELECT name, amount AS price FROM nodes WHERE kind = 'Part' AND amount > 990"),
    "cypher_distinct_top": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN DISTINCT l.reason AS reason, l.confidence AS confidence ORDER BY confidence DESC, reason SKIP 2 LIMIT 9", "SELECT DISTINCT reason, confidence FROM edges WHERE rel_type = 'CONTAINS' ORDER BY confidence DESC, reason LIMIT 9 OFFSET 2"),
    "cypher_union": ("MATCH (r:Region) RETURN r.kind AS kind UNION MATCH (n:Nation) RETURN n.kind AS kind", "SELECT 'Region' AS kind UNION SELECT 'Nation'"),
    "cypher_union_all": ("MATCH (r:Region) RETURN r.kind AS kind UNION ALL MATCH (n:Nation) RETURN n.kind AS kind", "SELECT kind FROM nodes WHERE kind IN ('Region', 'Nation')"),
    "cypher_global_aggregate": ("MATCH (n:Region) WHERE n.name = 'nowhere' RETURN count(*) AS n, sum(n.amount) AS total", "SELECT count(*) AS n, coalesce(sum(amount), 0) AS total FROM nodes WHERE name = 'nowhere'"),
}


def _query(text: str):
    return lambda spark, sf_dir: run(commerce.graph(spark, sf_dir), text)


QUERIES = {name: _query(text) for name, (text, _) in _CASES.items()}
ORACLES = {name: f"WITH {commerce.SQL} {sql}" for name, (_, sql) in _CASES.items()}
