"""The query language on small graphs, and against a plain interpreter of its joins."""

import random

import pytest
from weftgraph.cypher import CypherError, parse, run
from weftgraph.cypher.compiler import shaped
from weftgraph.plans.model import EDGES, FUNCTION_META, NODES, PropertyGraph


def graph(spark, nodes, edges, **side):
    """nodes: (id, name, kind); edges: (src, dst, rel, confidence, reason)."""
    n = spark.createDataFrame([(i, i, name, kind, None, None, 4, 0, 9, 0, 0, 1) for i, name, kind in nodes], NODES)
    e = spark.createDataFrame([(k, a, b, rel, c, why) for k, (a, b, rel, c, why) in enumerate(edges)], EDGES)
    return PropertyGraph(n, e, **side)


def rows(g, text, **kw):
    return sorted(map(tuple, run(g, text, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def chain(spark):
    return graph(spark, [(1, "a", "Function"), (2, "b", "Function"), (3, "c", "Function"), (4, "d", "Method")], [(1, 2, "Calls", 1.0, "x"), (2, 3, "Calls", 1.0, "x"), (3, 4, "Calls", 1.0, "x")])


@pytest.fixture(scope="module")
def fan(spark):
    return graph(spark, [(1, "fan", "Function"), (2, "leaf_a", "Function"), (3, "leaf_b", "Function")], [(1, 2, "Calls", 0.8, "r1"), (1, 3, "Calls", 0.6, "r2")])


def test_hops(chain):
    assert rows(chain, "MATCH (a)-[r:CALLS]->(b) RETURN a.name, b.name, type(r)") == [("a", "b", "Calls"), ("b", "c", "Calls"), ("c", "d", "Calls")]
    assert rows(chain, "MATCH (a)<-[:calls]-(b:Method|Function) WHERE b.name = 'c' RETURN a.name") == [("d",)]
    assert rows(chain, "MATCH (a {name: 'b'})-[]-(x) RETURN x.name") == [("a",), ("c",)]
    assert rows(chain, "MATCH (a)-->(b)-->(c) RETURN a.name AS x, c.name AS y") == [("a", "c"), ("b", "d")]


def test_spans(chain):
    one = "MATCH (a {{name: 'a'}})-[:Calls{}]->(b) RETURN b.name"
    assert rows(chain, one.format("*")) == [("b",)]
    assert rows(chain, one.format("*2")) == [("c",)]
    assert rows(chain, one.format("*2..")) == [("c",), ("d",)]
    assert rows(chain, one.format("*..2")) == [("b",), ("c",)]
    assert rows(chain, one.format("*0..1")) == [("a",), ("b",)]
    assert rows(chain, "MATCH (a)<-[r:Calls*1..3]-(b) WHERE a.name = 'd' RETURN b.name, r.reason") == [("a", "x"), ("b", "x"), ("c", "x")]


def test_shortest_depth_counts_once(spark):
    g = graph(spark, [(i, str(i), "Function") for i in (1, 2, 3)], [(1, 2, "Calls", 1.0, ""), (1, 3, "Calls", 1.0, ""), (2, 3, "Calls", 1.0, ""), (3, 1, "Calls", 1.0, "")])
    assert rows(g, "MATCH (a {name: '1'})-[*1..5]->(b) RETURN b.name") == [("2",), ("3",)]
    assert rows(g, "MATCH (a {name: '1'})-[*2]->(b) RETURN b.name") == []


def test_nulls_are_two_valued(chain):
    assert len(rows(chain, "MATCH (n) WHERE n.ownerClass = null RETURN n.name")) == 4
    assert rows(chain, "MATCH (n) WHERE n.ownerClass <> null RETURN n.name") == []
    assert len(rows(chain, "MATCH (n) WHERE NOT n.ownerClass = 'x' RETURN n.name")) == 4
    assert rows(chain, "MATCH (n) WHERE n.ownerClass > 'a' RETURN n.name") == []
    assert len(rows(chain, "MATCH (n) WHERE n.ownerClass IN ['q', null] RETURN n.name")) == 4
    assert rows(chain, "MATCH (n) WHERE n.name > 3 RETURN n.name") == []


def test_returned_variables(fan):
    df = run(fan, "MATCH (n {name: 'fan'})-[r]->(m) RETURN n, r")
    assert df.columns == ["n.name", "n.kind", "n.filePath", "r.rel_type", "r.confidence", "r.reason"]
    assert sorted(r[4] for r in df.collect()) == [0.6000000238418579, 0.800000011920929]
    assert rows(fan, "MATCH (n {name: 'fan'})-[r]->(m) RETURN n AS x, r AS y LIMIT 1") == [("fan", None)]
    assert rows(fan, "MATCH (n:Function) RETURN n.line, labels(n) LIMIT 1") == [(5, ["Function"])]


def test_aggregates(fan):
    got = run(fan, "MATCH (f {name: 'fan'})-[r]->(x) RETURN f.name AS f, count(*), sum(r.confidence) AS s, collect(x.name) AS xs, count(DISTINCT f) AS n, min(x.name) AS lo")
    assert got.columns[1] == "COUNT(*)"
    f, n, s, xs, d, lo = got.first()
    assert (f, n, round(s, 5), xs, d, lo) == ("fan", 2, 1.4, ["leaf_a", "leaf_b"], 1, "leaf_a")
    assert rows(fan, "MATCH (n:Method) RETURN count(*), sum(n.line), avg(n.line), collect(n.name)") == [(0, 0, None, [])]
    assert rows(fan, "MATCH (n:Method) WITH count(*) AS k RETURN k") == []
    assert rows(fan, "MATCH (f)-[r]->(x) WITH f, count(*) AS k WHERE k > 1 RETURN f.name, k, id(f)") == [("fan", 2, None)]


def test_order_and_pages(chain):
    assert [r[0] for r in run(chain, "MATCH (n) RETURN n.name ORDER BY n.name DESC SKIP 1 LIMIT 2").collect()] == ["c", "b"]
    assert len(rows(chain, "MATCH (n) RETURN n.name AS x ORDER BY n.name")) == 4
    assert rows(chain, "MATCH (n) RETURN DISTINCT n.kind") == [("Function",), ("Method",)]


def test_union(chain):
    assert rows(chain, "MATCH (n:Method) RETURN n.name UNION ALL MATCH (m:Method) RETURN m.name") == [("d",), ("d",)]
    assert rows(chain, "MATCH (n:Method) RETURN n.name UNION MATCH (m:Method) RETURN m.name") == [("d",)]
    with pytest.raises(CypherError):
        run(chain, "MATCH (n) RETURN n.name UNION MATCH (m) RETURN m.name, m.kind")


def test_commas_follow_one_another(chain):
    assert len(rows(chain, "MATCH (a:Method), (b:Function) RETURN a.name AS a, b.name AS b")) == 4
    assert len(rows(chain, "MATCH (a:Method), (b:Function) RETURN a.name AS a, b.name AS b", strict=True)) == 3


def test_clause_order_is_fixed(chain):
    assert rows(chain, "MATCH (a {name: 'a'}) WITH a MATCH (a)-[:Calls]->(b) RETURN b.name") == [("b",)]


def test_optional(chain):
    assert rows(chain, "MATCH (a) OPTIONAL MATCH (a)-[:Calls]->(b) RETURN a.name, b.name") == [("a", "b"), ("b", "c"), ("c", "d"), ("d", None)]


def test_repeated_variable_is_overwritten(spark):
    g = graph(spark, [(1, "x", "Function"), (2, "y", "Function")], [(1, 2, "Calls", 1.0, ""), (1, 1, "Calls", 1.0, "")])
    assert rows(g, "MATCH (a)-[]->(a) RETURN a.name") == [("x",), ("y",)]
    assert rows(g, "MATCH (a {name: 'x'})-[]-(b) RETURN b.name") == [("x",), ("x",), ("y",)]


def test_strings_and_patterns(chain):
    assert rows(chain, "MATCH (n) WHERE n.name =~ '[ab]' OR n.name STARTS WITH 'd' RETURN n.name") == [("a",), ("b",), ("d",)]
    assert rows(chain, "MATCH (n) WHERE n:Method RETURN n.name") == [("d",)]
    assert rows(chain, "MATCH (n) WHERE n:method RETURN n.name") == []


def test_metadata(spark):
    meta = spark.createDataFrame([(1, True, False, False, False, False, False, 2, [], None, ["@Override", "app.get"])], FUNCTION_META)
    g = graph(spark, [(1, "t", "Function"), (2, "u", "Function")], [], function_meta=meta)
    assert rows(g, "MATCH (n) WHERE n.isTest = true RETURN n.name, n.visibility, n.decorators") == [("t", 2, ["Override", "app.get"])]
    assert rows(g, "MATCH (n) WHERE 'Override' IN n.decorators RETURN n.name") == [("t",)]
    assert rows(g, "MATCH (n) WHERE n.is_async = false AND n.visibility = 0 RETURN n.name") == [("u",)]


def test_content(spark):
    nodes = spark.createDataFrame([(1, 1, "f", "Function", 7, None, 0, 4, 1, 3, 0, 1), (2, 2, "g", "Function", 7, None, 5, 0, 9, 0, 0, 1)], NODES)
    src = spark.createDataFrame([(7, "def é():\n  pass\nend")], "file_id long, text string")
    g = PropertyGraph(nodes, spark.createDataFrame([], EDGES), sources=src)
    assert rows(g, "MATCH (n) RETURN n.name, n.content") == [("f", "é():\n  p"), ("g", "")]


def test_errors(chain):
    for bad in ("MATCH (n RETURN n", "MATCH (n) RETURN", "RETURN 1", "MATCH (n:Nothing) RETURN n.name", "MATCH (n) WHERE n.uid = 'x' RETURN n.name", "MATCH (n) WHERE id(n) = 1 RETURN n.name", "MATCH (n) RETURN *"):
        with pytest.raises(CypherError):
            run(chain, bad)
    with pytest.raises(CypherError, match=r"\^"):
        parse("MATCH (n) WHERE ~ RETURN n")
    with pytest.warns(UserWarning, match="did you mean name"):
        run(chain, "MATCH (n) RETURN n.nam")


def test_shaping(chain):
    assert shaped(run(chain, "MATCH (n:Method) RETURN n.name AS x")) == {"columns": ["x"], "rows": ["d"]}


def test_against_a_plain_interpreter(spark):
    r = random.Random(3)
    nodes = [(i, f"n{i % 5}", r.choice(["Function", "Method", "Class"])) for i in range(12)]
    edges = [(r.randrange(12), r.randrange(12), r.choice(["Calls", "Extends"]), 1.0, "") for _ in range(30)]
    g = graph(spark, nodes, edges)
    name = {i: n for i, n, _ in nodes}
    kind = {i: k for i, _, k in nodes}
    for rel in ("Calls", "Extends"):
        hop = [(a, b) for a, b, x, *_ in edges if x == rel]
        want = sorted((name[a], name[d]) for a, b in hop for c, d in hop if b == c and kind[a] == "Function")
        assert rows(g, f"MATCH (a:Function)-[:{rel}]->(b)-[:{rel}]->(c) RETURN a.name, c.name") == sorted(want, key=repr)
        depth = {a: {a: 0} for a in name}
        for a in name:
            todo = [a]
            for x in todo:
                for s, t in hop:
                    if s == x and t not in depth[a]:
                        depth[a][t] = depth[a][x] + 1
                        todo.append(t)
        want = sorted(((a, b) for a in name for b, d in depth[a].items() if 2 <= d <= 3), key=repr)
        assert rows(g, f"MATCH (a)-[:{rel}*2..3]->(b) RETURN id(a), id(b)") == want


def test_a_filter_comes_before_a_path_of_any_length(spark, data, monkeypatch):
    """The path starts from the filtered node alone; the result is that of an inline property."""
    from weftgraph.cypher import compiler
    from weftgraph.sources import commerce

    seen = []
    plain = compiler.reach
    monkeypatch.setattr(compiler, "reach", lambda seeds, *a, **k: seen.append(seeds.distinct().count()) or plain(seeds, *a, **k))
    g = commerce.graph(spark, data)
    filtered = compiler.run(g, "MATCH (a)-[:IN_NATION|IN_REGION*1..3]->(b) WHERE a.name = 'Customer#000000007' AND b.kind <> 'Order' RETURN b.name")
    inline = compiler.run(g, "MATCH (a {name: 'Customer#000000007'})-[:IN_NATION|IN_REGION*1..3]->(b) RETURN b.name")
    assert seen == [1, 1] and sorted(map(tuple, filtered.collect())) == sorted(map(tuple, inline.collect())) != []
