"""Operators that the registered queries do not hold against SQL, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from weftgraph.plans import graph_queries
from weftgraph.functions import text as X
from weftgraph.operators import derive, detect, diff, processes, routes, search, telemetry, tools, traverse
from weftgraph.plans.model import EDGES, FILES, NODES, PropertyGraph
from weftgraph.sources import code, contracts, logs, shapes
from weftgraph.streaming import inbox


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in "abc"[: len(rows[0])])).orderBy("i").select(column).collect()]


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_identifier_tokens(spark):
    cases = {"parse_config_file": ["parse_config_file", "parse", "config", "file"], "parseConfig": ["parseconfig", "parse", "config"], "HTTPServer": ["httpserver", "http", "server"], "utf8": ["utf8", "utf", "8"], "base64Decode": ["base64decode", "base", "64", "decode"], "foo.bar-baz/qux": ["foo.bar-baz/qux", "foo", "bar", "baz", "qux"], "config": ["config"], "": []}
    assert values(spark, X.identifier_tokens(F.col("a")), *((k,) for k in cases)) == list(cases.values())


def test_routes_and_reasons(spark):
    assert values(spark, X.route_path(F.col("a")), ("/users/{id}/:x/?q=1",), ("<p>/${v}/a",), ("",), ("/user-${id}/a#b",), ("//a/x-{y}/:",)) == ["users/:*/:*", ":*/:*/a", "", ":*/a#b", "a/x-{y}/:*"]
    code_ = X.reason(F.array(F.col("a"), F.col("b")), F.lit(3))
    assert values(spark, X.reason_keys(code_), ("x", "y")) == [["x", "y"]]
    assert values(spark, X.reason_fetches(code_), ("x", "y")) == [3]
    assert values(spark, X.topic(F.col("a")), ("prod.OrderCreated.v2",), ("order_created",), ("a-b/c",), ("HTTPServer",), ("dev.prod.x",), ("test.XMLParser:Ok.v1.2",), ("",)) == ["order/created", "order/created", "a/b/c", "http/server", "prod/x", "test/xml/parser/ok/v1/2", ""]
    assert values(spark, routes.excluded(F.col("a")), ("/{a}/:b",), ("/x/{a}",), ("",)) == [True, False, True]
    assert values(spark, X.file_category(F.col("a")), ("src/a.py",), ("tests/test_a.py",), ("docs/x.md",), ("examples/test_a.py",), ("a.toml",), ("vendor/tests/x.py",), ("Dockerfile",), ("FooTest.java",), ("Manifest.java",), ("a.ini",), ("docs/x.py",), ("a\\\\Tests\\\\x.cs",)) == ["Source", "Test", "Document", "Example", "Config", "Reference", "Config", "Test", "Source", "Source", "Source", "Test"]


def test_globs():
    import re

    assert re.match(X.glob_pattern("order.*"), "order.created") and not re.match(X.glob_pattern("order.*"), "order.a.b") and re.match(X.glob_pattern("order.**"), "order.a.b")


def small(spark, nodes, edges, categories=None):
    n = spark.createDataFrame([(i, i, name, kind, i % 2, owner, a, 0, b, 0, 0, 1) for i, name, kind, owner, a, b in nodes], NODES)
    e = spark.createDataFrame([(k, s, d, rel, c, "") for k, (s, d, rel, c) in enumerate(edges)], EDGES)
    files = spark.createDataFrame([(k, f"f{k}", 0, 0, c, "python") for k, c in enumerate(categories)], FILES) if categories else None
    return PropertyGraph(n, e, files=files)


def test_impact_buckets_tests_and_ties(spark):
    g = small(spark, [(i, f"n{i}", "Function", None, 0, 9) for i in range(6)], [(1, 0, "Calls", 1.0), (2, 0, "MirrorsField", 0.9), (3, 1, "Calls", 1.0), (3, 2, "Calls", 1.0), (4, 3, "Defines", 1.0), (5, 3, "Calls", 0.2)], ["Source", "Test"])
    seeds = spark.createDataFrame([(0,)], "seed long")
    full = traverse.impact(g, seeds, "up", 5, 0.5)
    assert got(full, "node", "depth", "via", "bucket") == [(1, 1, 0, "deterministic"), (2, 1, 1, "heuristic"), (3, 2, 2, "deterministic")]
    assert got(traverse.impact(g, seeds, "up", 5, 0.5, tests=False), "node") == [(2,)]
    assert got(traverse.impact(g, seeds, "up", 5, 0.5, heuristic=False), "node") == [(1,), (3,)]
    assert got(traverse.hidden_edges(g, seeds.select("seed", F.lit(3).cast("long").alias("node")), "up", 0.5), "low_confidence", "heuristic") == [(1, 0)]
    with pytest.raises(ValueError):
        traverse.resolve_targets(small(spark, [(1, "x", "Function", None, 0, 1), (2, "x", "Method", None, 0, 1)], []), "x")


def test_depth_is_the_shortest_path(spark):
    import random

    r = random.Random(5)
    pairs = [(r.randrange(15), r.randrange(15)) for _ in range(30)]
    g = small(spark, [(i, str(i), "Function", None, 0, 1) for i in range(15)], [(a, b, "Calls", 1.0) for a, b in pairs])
    seen = {0: 0}
    todo = [0]
    for x in todo:
        for a, b in pairs:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    assert got(traverse.callees_of(g, 0, 20), "node", "depth") == sorted(seen.items(), key=repr)


def test_communities_find_triangles(spark):
    tri = [(1, 2), (2, 3), (3, 1), (11, 12), (12, 13), (13, 11), (3, 11)]
    g = small(spark, [(i, str(i), "Function", None, 0, 1) for i in (1, 2, 3, 11, 12, 13)], [(a, b, "Calls", 1.0) for a, b in tri])
    found = processes.communities(g.nodes, g.edges)
    c = dict(found.collect())
    assert c[1] == c[2] == c[3] != c[11] == c[12] == c[13]
    assert processes.modularity(g.edges, found).first()["q"] > 0.3


def test_communities_are_split_into_connected_parts(spark):
    links = spark.createDataFrame([(a, b) for x, y in [(1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (8, 9), (3, 5)] for a, b in ((x, y), (y, x))], "a long, b long")
    placed = spark.createDataFrame([(i, 1 if i < 4 or i > 5 else 2) for i in (1, 2, 3, 5, 6, 7, 8, 9, 20)], "id long, c long")
    assert sorted(got(processes.split(links, placed), "id", "part")) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 6), (7, 6), (8, 6), (9, 6), (20, 20)]


def test_large_graphs_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(processes, "LARGE", 3)
    g = small(spark, [(i, str(i), "Function", None, 0, 1) for i in (1, 2, 3, 4)], [(1, 2, "Calls", 1.0), (2, 3, "Calls", 1.0), (3, 1, "Calls", 0.9), (3, 4, "Calls", 0.9), (4, 1, "Calls", 0.1)])
    nodes, edges = processes.thinned(g.nodes, g.edges)
    assert got(nodes, "id") == [(1,), (2,), (3,)] and edges.count() == 3


def test_process_pieces(spark):
    t = spark.createDataFrame([(1, [1, 2, 3, 4]), (1, [2, 3, 4]), (1, [1, 5, 4]), (9, [9, 8, 7])], "entry long, steps array<long>")
    whole = processes.distinct_traces(t)
    assert got(whole, "entry", "terminal", "steps") == [(1, 4, [1, 2, 3, 4]), (9, 7, [9, 8, 7])]
    kinds = processes.process_type(whole, spark.createDataFrame([(1, 1), (2, 2), (9, 3), (8, 0)], "id long, community_id int"))
    assert got(kinds, "entry", "process_type") == [(1, "cross"), (9, "intra")]
    steps = processes.step_edges(spark.createDataFrame([(5, [3, 4])], "process_id long, steps array<long>"))
    assert got(steps, "src", "dst", "reason") == [(3, 5, "step:1"), (4, 5, "step:2")]


def test_detectors(spark):
    nodes = [(1, "Order", "EventTopic", None, 0, 0), (2, "Ship", "EventTopic", None, 0, 0), (3, "pub", "Function", None, 0, 0), (4, "sub", "Function", None, 0, 0), (5, "pay", "Method", "Svc", 0, 0), (6, "undo_pay", "Method", "Svc", 0, 0), (7, "OutboxEvents", "Class", None, 0, 0), (8, "save", "Method", "OutboxEvents", 0, 0)]
    edges = [(1, 2, "EventTopicMirror", 0.9), (3, 1, "Publishes", 1.0), (4, 2, "Subscribes", 1.0), (5, 6, "CompensatedBy", 0.8), (8, 3, "Calls", 1.0)]
    g = small(spark, nodes, edges)
    assert got(detect.event_mirrors(g.nodes, g.edges, "O*"), "topic", "mirror", "publisher", "subscriber") == [("Order", "Ship", 3, 4)]
    assert got(detect.saga_list(g.nodes, g.edges, "Svc"), "action", "compensation", "tier") == [("pay", "undo_pay", "strong")]
    assert got(detect.outbox(g.nodes, g.edges), "table_id", "writer_id", "publisher_id", "confidence") == [(7, 8, 3, 0.8)]
    lines = spark.createDataFrame([("a/tests/x.py", 1, "x = pay(1)"), ("a.md", 2, "# pay here"), ("a.py", 3, "payment()"), ("a.py", 4, "s = 'do pay'"), ("a_test.go", 5, "pay"), ("a.yml", 6, "pay: 1"), ("a.py", 7, "épay")], "path string, line int, text string")
    assert got(detect.mentions(lines, "pay"), "line", "context") == [(1, "test"), (2, "markdown"), (4, "code"), (5, "test"), (6, "data")]
    lit = spark.createDataFrame([("session_meta.json", "d", "json", "read"), ("session-meta.json", "d", "json", "write"), ("other.json", "d", "json", "write"), ("session_meta.json", "e", "json", "write")], "literal string, directory string, extension string, access string")
    assert got(detect.literal_pairs(lit), "read", "written") == [("session_meta.json", "session-meta.json")]
    odd = [("cfg", "read"), ("data", "read"), ("my-data.old", "write"), ("----", "read"), ("a ---- b", "write"), ("x" * 40, "write"), ("x" * 34 + "y", "read"), ("dataset", "write"), ("a/b/long_name", "write"), ("long_name", "read"), ("", "read")]
    lit = spark.createDataFrame([(x, "d", "e", a) for x, a in odd], "literal string, directory string, extension string, access string")
    brute = lit.where("access = 'read'").select(F.col("literal").alias("read")).crossJoin(lit.where("access = 'write'").select(F.col("literal").alias("written"))).where(X.literal_likeness(F.col("read"), F.col("written")) >= 0.85)
    assert got(detect.literal_pairs(lit), "read", "written") == got(brute, "read", "written") != []
    both = spark.createDataFrame([("T", "Class"), ("T", "Impl"), ("U", "Impl")], "name string, kind string")
    assert got(detect.without_impls(both), "name", "kind", "suppressed") == [("T", "Class", 1), ("U", "Impl", 0)]


def test_verdicts_of_a_resolver(spark):
    e = spark.createDataFrame([("a", "./x.d.ts"), ("b", "y/index.ts"), ("c", "z.ts"), ("d", None), ("e", None), ("f", "q.ts"), ("g", "q.ts")], "key string, target string")
    d = [("a", "x.js", "Global", 2), ("a", "w.js", "AmbiguousGlobal", 0), ("b", "y.tsx", "ImportScoped", 0), ("c", "other.ts", "SameFile", 0), ("d", "n.ts", "Global", 0), ("e", None, "Unresolved", 0), ("f", None, "Unresolved", 0), ("h", "k", "SameFile", 0), ("i", "k", "Global", 0)]
    decided = spark.createDataFrame(d, "key string, target string, tier string, alt_count int")
    assert got(detect.verify(e, decided, "typescript"), "tier", "verdict", "n") == sorted([("Global", "TP", 1), ("Global", "demoted", 1), ("Global", "FP_overmatch", 1), ("ImportScoped", "TP", 1), ("SameFile", "FP_ghost", 1), ("Global", "FP_ghost", 1), ("Unresolved", "FN", 1), (None, "expected_only", 1), ("SameFile", "decided_same_file", 1), ("Global", "decided_other", 1)], key=repr)
    paths = spark.createDataFrame([("a/b.d.ts", "typescript"), ("p/__init__.py", "python"), ("c\\m/mod.rs", "rust")], "p string, l string")
    assert [r[0] for x in ("typescript", "python", "rust") for r in paths.where(F.col("l") == x).select(detect.module_path(F.col("p"), x)).collect()] == ["a/b", "p", "c/m"]


def test_renames_and_areas(spark):
    g = small(spark, [(1, "pay", "Function", None, 0, 1), (2, "pay", "Method", "Svc", 0, 1), (4, "a", "Function", None, 0, 1), (5, "b", "Function", None, 0, 1)], [(4, 1, "Calls", 1.0), (5, 1, "MirrorsField", 1.0), (1, 4, "MirrorsField", 1.0), (5, 2, "Calls", 1.0)])
    bare, owned = detect.rename_targets(g.nodes, "pay"), detect.rename_targets(g.nodes, "Svc.pay")
    assert got(bare, "id") == [(1,)] and got(owned, "id") == [(2,)]
    assert got(detect.rename_files(g, bare), "file_id", "edges") == [(0, 1), (1, 0)]
    assert got(detect.rename_guesses(g, bare), "name", "n") == [("a", 1), ("b", 1)]
    p = spark.createDataFrame([(1, "docs/a"), (1, "x.md"), (2, "docs/a"), (2, "src/x"), (3, "src/x")], "c long, path string")
    assert got(detect.areas(p, "c", "path", {"^docs/": "docs", "md$": "docs"}), "c", "area") == [(1, "docs"), (2, None), (3, None)]
    names = spark.createDataFrame([(1, "<anonymous:3>"), (2, "<anonymous:3>"), (1, "f"), (2, "f")], "c long, s string")
    assert got(detect.conflicts(names, "c", "s"), "a", "b", "common") == [(1, 2, 1)]


def test_tools(spark):
    files = spark.createDataFrame([(1, "a.ts"), (2, "b.py"), (3, "c.go"), (4, "d.rs"), (5, "tests/e.py"), (6, "f.py")], "file_id long, path string")
    texts = {
        1: ["import axios, { get as g } from 'axios/lib';", "import * as pgx from \"pg\";", "const { a: b, c } = require('redis');", "let q = require(\"bull\")", "axios.get(axios.x, xaxios.y, g(1), g, fetch(u))", "pgx.Client(); b.c; c(); q()"],
        2: ["import os, requests as r, boto3", "from sqlalchemy import a as b, c", "import urllib.request", "r.get(1); boto3.client; b(); c.d; os.x; requests.get", "urllib.request.open", "from redis import r"],
        3: ["import (", "\t\"net/http\"", "db \"sqlx/v2\"", ")", "http.Get(db.Open)"],
        4: ["use reqwest::Client as C;", "use redis::{aio::Conn, Cmd as K};", "use hyper;", "C::new(); C.x; Conn(); K.y; hyper.z"],
        5: ["import requests", "requests.get()"],
        6: ["requests.get()", "fetch()"],
    }
    lines = spark.createDataFrame([(f, k, t) for f, rows in texts.items() for k, t in enumerate(rows)], "file_id long, line int, text string")
    found = {(r.file_id, r.callee, r.package, r.category) for r in tools.uses(lines, files).collect()}
    assert found == {
        (1, "axios.get", "axios/lib", "http"), (1, "axios.x", "axios/lib", "http"), (1, "g", "axios/lib", "http"), (1, "fetch", "fetch", "http"), (1, "pgx.Client", "pg", "db"), (1, "b.c", "redis", "redis"), (1, "c", "redis", "redis"), (1, "q", "bull", "queue"),
        (2, "r.get", "redis", "redis"), (2, "boto3.client", "boto3", "queue"), (2, "b", "sqlalchemy", "db"), (2, "c.d", "sqlalchemy", "db"), (2, "urllib.request.open", "urllib.request", "http"),
        (3, "http.Get", "net/http", "http"), (3, "db.Open", "sqlx/v2", "db"),
        (4, "C.x", "reqwest", "http"), (4, "Conn", "redis", "redis"), (4, "K.y", "redis", "redis"), (4, "hyper.z", "hyper", "http"),
    }
    assert {r.category for r in tools.uses(lines, files, ("db",)).collect()} == {"db"}
    with pytest.raises(ValueError):
        tools.uses(lines, files, ("mail",))


def test_import_steps(spark):
    files = spark.createDataFrame([("inc/lib/alpha.hpp", 1), ("src/pkg.go", 2), ("src/store.rs", 3), ("Models/Order.cs", 4), ("Models/Order.vb", 5), ("Twice/a.cs", 6), ("Twice/b.cs", 7), ("x/util.h", 8), ("y/util.h", 9), ("src/near.rb", 10)], "path string, node_id long")
    asked = [(1, "m.cpp", "<lib/alpha.hpp>", "n"), (2, "cmd/m.go", "example.org/mod/pkg", "n"), (3, "src/m.rs", "crate::db::store", "Foo"), (4, "App/m.cs", "Models", "n"), (5, "App/m.cs", "Twice", "n"), (6, "m.c", '"util.h"', "n"), (7, "src/m.rs", "crate", "store"), (8, "src/m.rs", "std::store", "n"), (9, "src/a.rb", "near", "n"), (10, "A.kt", "none", "com.x.Alpha")]
    imports = spark.createDataFrame(asked, "import_id long, path string, specifier string, name string")
    symbols = spark.createDataFrame([(50, "Alpha"), (51, "Twin"), (52, "Twin")], "id long, name string")
    assert got(derive.import_edges(imports, symbols, files), "import_id", "dst") == [(1, 1), (10, 50), (2, 2), (3, 3), (4, 4), (7, 3), (9, 10)]


def test_scopes_and_inline_routes(spark):
    nodes = [(0, "GET /a", "Route", None, 5, 5), (2, "GET /a", "Route", None, 30, 30), (4, "outer", "Function", None, 0, 20), (6, "<anonymous:5:1>", "Function", None, 5, 6), (8, "K", "Const", None, 5, 5), (10, "h", "Function", None, 40, 41), (12, "up", "Function", None, 50, 51)]
    g = small(spark, nodes, [(10, 2, "HandlesRoute", 1.0), (12, 4, "Calls", 1.0)])
    assert got(routes.inspect_route(g, "/a"), "route_id", "handler", "seed", "node", "depth") == [(0, "inline_anonymous", 4, 12, 1), (0, "inline_anonymous", 4, 4, 0), (2, "named", 10, 10, 0)]
    s = spark.createDataFrame([(1, 9, "", "File", None), (2, 9, "N", "Namespace", None), (3, 9, "f", "Function", "N"), (4, 9, "m", "Method", "Class"), (5, 9, "P", "Property", None), (6, 9, "g", "Function", "")], "id long, file_id long, name string, kind string, owner_class string")
    assert got(derive.scope_defines(s), "src", "dst") == [(1, 2), (1, 6), (2, 3)]


def test_extractors(spark, tmp_path):
    texts = {
        "a.go": 'mux.HandleFunc("/u", create)\nr.GET("/u/{id}", s.get)\nhttp.ListenAndServe(":80", mux)\npb.RegisterUserServer(s, &x{})',
        "a.py": '@app.route("/u", methods=["POST", \'put\'])\n@auth\ndef create():\n  pass\n\n@r.get("/u/<id>")\nasync def one(id):\n  pass\n@app.route("/all")\ndef every(): pass\n@app.route("/k")\nclass K: pass\nu.add_UserServicer_to_server(x, s)\nadd_XServicer_to_server()',
        "a.tsx": "app.post('/u', create)\napp.all(\"/x\", (a, b) => 1)\napp.listen('/y', z)\ns.addService(user.User.service, {})",
        "A.java": '@RequestMapping("/api")\npublic class A {\n@PostMapping("/u") @Auth("x") public Map<String, User> create(X x) {}\n.addService(new UserGrpc.UserImplBase() {}) }',
        "a.rs": '.route("/u", post(create)).route("/n", service(x))\n#[get("/u/{id}")]\n#[auth]\npub async fn one() {}\n#[any("/z")]\nstruct S;\n.add_service(pb::u::UserServer::new(x))',
        "a.txt": 'mux.HandleFunc("/u", create)',
    }
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()] + [("r", "null.go", None)], "repo string, path string, text string")
    found = {(r.contract_id, r.symbol) for r in contracts.extracted(files).collect()}
    assert found == {
        ("http:ANY:/u", "a.go::create"), ("http:GET:/u/{id}", "a.go::s.get"), ("grpc:User:*", "a.go::RegisterUserServer"),
        ("http:POST:/u", "a.py::create"), ("http:PUT:/u", "a.py::create"), ("http:GET:/u/<id>", "a.py::one"), ("http:ANY:/all", "a.py::every"), ("grpc:User:*", "a.py::add_UserServicer_to_server"),
        ("http:POST:/u", "a.tsx::create"), ("http:ANY:/x", "a.tsx::<unknown>"), ("grpc:User:*", "a.tsx::addService::User"),
        ("http:POST:/u", "A.java::create"), ("grpc:User:*", "A.java::addService::UserImplBase"),
        ("http:POST:/u", "a.rs::create"), ("http:GET:/u/{id}", "a.rs::one"), ("http:ANY:/z", "a.rs::<unknown>"), ("grpc:User:*", "a.rs::add_service::UserServer"),
    }
    words = contracts.Extractor("go", "custom", lambda text: F.transform(F.array(text), lambda t: F.struct(F.substring(t, 1, 3), F.lit("n"), F.lit("s"), F.lit(1.0), F.create_map(F.lit("a"), F.lit("b"))).cast(contracts.ITEM)))
    assert got(contracts.extracted(files, [words]), "contract_id", "contract_type") == [("mux", "custom")]
    members = spark.createDataFrame([("r",), ("gone",)], "repo string")
    asked = spark.createDataFrame([("w", "http:POST:/u", "http", "consumer", "c", "f", "n", 0.5, {})], "repo string, contract_id string, contract_type string, role string, symbol string, file_path string, symbol_name string, confidence float, meta map<string,string>")
    stored, links, missing = contracts.synced(files, members, str(tmp_path / "g"), asked)
    assert stored.count() == len(found) + 1 and got(missing, "repo") == [("gone",)]
    assert {r.p_symbol for r in links.where("match_type = 'exact'").collect()} == {"a.py::create", "a.tsx::create", "A.java::create", "a.rs::create"}


def test_fetches_and_keys(spark):
    text = F.col("a")
    found = values(spark, F.transform(shapes.fetched(text), lambda f: F.concat_ws(" ", f["method"], f["url"])), ('fetch("/api/users")',), ("fetch('/api/users', { 'method': 'POST' }); fetch('/api/users')",), ('fetch(`/a/${id}`); prefetch("/b"); axios . delete ( "/c" )',), ("$.post('/d'); httpx.head('/e'); requests.patch(\"/f\"); requests.get('/f')",), ("",), (None,))
    assert found == [["GET /api/users"], ["POST /api/users"], ["DELETE /c"], ["POST /d", "HEAD /e", "PATCH /f", "GET /f"], [], None]
    keys = values(spark, shapes.read_keys(text), ("const { id, name: n } = await res.json()",), ('const { items } = await fetch("/x").json()',), ("let { total } = data; mydata.x; dataset.y",), ("response?.bar; result.baz; data.map(x); body .foo; json.length",), ("",))
    assert keys == [["id", "name"], ["items"], ["total"], ["bar", "baz", "foo"], []]


def test_answers(spark):
    js = {
        "res.status(200).json({ id, name })": (["id", "name"], []),
        'res.status(400).json({ error: "bad" })': ([], ["error"]),
        "return Response.json({ msg }, { status: 401 })": ([], ["msg"]),
        "res.json({ id, name: u.name, user: { no, never: 1 }, age: 10 })": (["age", "id", "name", "user"], []),
        "res.json({ \"courses\": 1, 'flag': 2, x: 'y', z: \"{ q: 1 }\" })": (["courses", "flag", "x", "z"], []),
        "res.json({ ...rest, id })": (["id", "rest"], []),
        "if (err) res.status(500).json({ error }); else res.json({a, ok})": (["a", "ok"], ["error"]),
        "return new Response(JSON.stringify({ items })); res.json(rows); res.json({ open: 1": (["open"], []),
    }
    for text, want in js.items():
        assert tuple(map(sorted, shapes.script_shape(text))) == want, text
    php = {
        "echo json_encode(['a' => 1, \"b\" => ['no' => 2], 'c' => f('x', ['y' => 1])]);": (["a", "b", "c"], []),
        "http_response_code(404); echo json_encode(array('error' => 'x', 'why' => array('z' => 1)));": ([], ["error", "why"]),
        "http_response_code(500); die('no'); echo json_encode(['ok' => \"it's [fine\"]);": (["ok"], []),
        "header('HTTP/1.1 403 Forbidden'); json_encode(['e' => 1]); header('Status: 200'); json_encode($x); json_encode(['open' => 1": ([], ["e"]),
    }
    for text, want in php.items():
        assert tuple(map(sorted, shapes.php_shape(text))) == want, text
    files = spark.createDataFrame([(1, "typescript", "res.json({ a })"), (2, "python", "res.json({ a })"), (3, "php", ""), (4, "php", None)], "file_id long, language string, text string")
    assert got(shapes.answers(files), "file_id", "response_keys", "error_keys") == [(1, ["a"], [])]


def test_derivations(spark):
    nodes = small(spark, [(1, "C", "Class", None, 0, 20), (2, "m", "Method", None, 2, 4), (3, "D", "Class", None, 30, 40), (5, "n", "Method", "C", 50, 52), (7, "p", "Property", None, 3, 3)], []).nodes.withColumn("file_id", F.lit(0).cast("long"))
    assert got(derive.membership(nodes), "src", "dst", "rel_type") == [(1, 2, "HasMethod"), (1, 5, "HasMethod"), (1, 7, "HasProperty")]
    m = spark.createDataFrame([(1, "S", "pay"), (2, "S", "undo_pay"), (3, "T", "rollbackPay"), (4, "T", "pay"), (5, "S", "undone"), (6, "S", "ne"), (7, "S", "revert_pay"), (8, "S", "UndoBook"), (9, "S", "Book"), (10, "S", "book")], "id long, owner string, name string")
    calls = spark.createDataFrame([(2, 1)], "src long, dst long")
    assert got(derive.saga_pairs(m, calls), "src", "dst", "confidence") == [(1, 2, 0.8), (4, 3, 0.6), (9, 8, 0.6)]
    over = spark.createDataFrame([("T", "S")], "owner string, parent string")
    assert got(derive.overrides(m, over), "src", "dst") == [(4, 1)]
    q = spark.createDataFrame([(1, "INSERT INTO Orders SELECT * FROM items"), (2, "select * from orders")], "id long, sql string")
    t = spark.createDataFrame([(10, "orders"), (11, "Items")], "id long, name string")
    assert got(derive.table_refs(q, t), "src", "dst", "reason") == [(1, 10, "write"), (1, 11, "read"), (2, 10, "read")]
    lits = spark.createDataFrame([(1, "a/b.json", "fs.open"), (2, "http://x/y", "open"), (3, "a b/c", "open"), (4, "cfg.toml", "x.dump")], "id long, text string, callee string")
    assert got(derive.path_literals(lits), "id", "access") == [(1, "read"), (4, "write")]
    syms = spark.createDataFrame([(1, 1, "f", None, "py"), (2, 2, "g", "K", "py"), (3, 2, "h", None, "py"), (4, 3, "h", None, "py")], "id long, file_id long, name string, owner string, language string")
    refs = spark.createDataFrame([(1, 1, "f", None, None, "py"), (2, 1, "g", "K", None, "py"), (3, 1, "h", None, None, "py"), (4, 9, "h", None, None, "py"), (5, 9, "g", None, "Sub", "py")], "ref_id long, file_id long, name string, qualifier string, owner string, language string")
    imp = spark.createDataFrame([(1, "h", 3)], "file_id long, name string, target_file long")
    her = spark.createDataFrame([("Sub", "K")], "owner string, parent string")
    assert got(derive.resolve(refs, syms, imp, her), "ref_id", "id", "tier") == [(1, 1, "same_file"), (2, 2, "qualifier"), (3, 4, "import"), (5, 2, "heritage")]
    files = spark.createDataFrame([("pkg/util.py", 100), ("pkg/a.py", 101)], "path string, node_id long")
    ims = spark.createDataFrame([(1, "pkg/a.py", "./util", "zz"), (2, "pkg/a.py", "pkg.util", "f"), (3, "x.py", "nowhere", "zz")], "import_id long, path string, specifier string, name string")
    assert got(derive.import_edges(ims, syms, files), "import_id", "dst", "confidence") == [(1, 100, 0.9), (2, 1, 0.95)]
    dec = spark.createDataFrame([(1, "@K(1)"), (2, "mark")], "id long, decorator string")
    assert got(derive.decorates(dec, spark.createDataFrame([(9, "K")], "id long, name string")), "dst", "confidence") == [(1, 1.0), (2, 0.8)]


def rows_out(df, node, metric="numOutputRows"):
    """Rows that the nodes of a kind gave in all, of a plan that has run; or another of their metrics."""

    def walk(p):
        name, inner = p.nodeName(), [p.children().apply(k) for k in range(p.children().size())]
        if name == "AdaptiveSparkPlan":
            inner = [p.executedPlan()]
        elif name.endswith("QueryStage"):
            inner = [p.plan()]
        own = p.metrics().get(metric)
        return sum(map(walk, inner)) + (own.get().value() if node in name and own.isDefined() else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_common_names_are_resolved_without_listing_candidates(spark):
    n, side = 500, "id long, file_id long, name string, owner string, language string"
    symbols = spark.createDataFrame([(k, 1, "common", "K", "py") for k in range(n)] + [(n, 1, "only", "K", "py")], side)
    refs = spark.range(n + 1).selectExpr("id AS ref_id", "1L AS file_id", f"IF(id = {n}, 'only', 'common') AS name", "'K' AS qualifier", "CAST(NULL AS STRING) AS owner", "'py' AS language")
    found = derive.resolve(refs, symbols)
    assert [tuple(r) for r in found.collect()] == [(n, n, "same_file", 1.0)]
    assert rows_out(found, "Join") <= 3 * (n + 1)


def test_repeated_symbols_and_references(spark):
    """Copies of a symbol are one candidate; rows of one reference share their candidates."""
    symbols = spark.createDataFrame([(1, 1, "f", "K", "py"), (1, 1, "f", "K", "py"), (2, 2, "g", "K", "py"), (3, 3, "g", "L", "py"), (None, 4, "h", "K", "py"), (5, 5, None, "K", "py")], "id long, file_id long, name string, owner string, language string")
    rows = [(1, 9, "f", None), (2, 2, "g", None), (2, 3, "g", None), (3, 2, "g", None), (3, 2, "g", None), (4, 9, "h", None), (5, 5, None, "K"), (6, 9, "f", None), (6, 9, "g", None), (7, 9, "g", "L"), (8, 8, "g", None)]
    refs = spark.createDataFrame([(*r, "S", "py") for r in rows], "ref_id long, file_id long, name string, qualifier string, owner string, language string")
    assert got(derive.resolve(refs, symbols), "ref_id", "id", "tier") == [(1, 1, "unique_global"), (3, 2, "same_file"), (7, 3, "qualifier")]
    imports = spark.createDataFrame([(8, "g", 2), (8, "g", 3), (9, "g", 2), (9, "g", 2)], "file_id long, name string, target_file long")
    heritage = spark.createDataFrame([("S", "K"), ("S", "L")], "owner string, parent string")
    want = [(1, 1, "heritage"), (3, 2, "same_file"), (6, 2, "import"), (7, 2, "import")]
    assert got(derive.resolve(refs, symbols, imports, heritage), "ref_id", "id", "tier") == want


@pytest.mark.parametrize("block", [1024, 3])
def test_schema_mirrors_against_all_pairs(spark, monkeypatch, block):
    """Nulls equal nothing, names count with their case, repeated rows and ids with several fields give each pair once."""
    monkeypatch.setattr(derive, "BLOCK_ROWS", block)
    rows = [(k, "ab"[k % 2], f"t{k % 3}" if k % 7 else None, f"o{k % 4}" if k % 5 else None) for k in range(60)]
    rows += [(3, "a", "t0", "o1"), (3, "b", "t1", None), (60, "A", "t1", "o1"), (60, "A", "t1", "o1"), (61, None, "t1", "o1"), (62, None, "t1", "o1"), (None, "a", "t1", "o1"), (63, "A", "t9", "o1"), (64, "c", None, None), (65, "c", None, None)]
    want = {(a[0], b[0], 0.9) for a in rows for b in rows if None not in (a[0], b[0], a[1]) and a[0] < b[0] and a[1] == b[1] and (a[2] == b[2] is not None or a[3] == b[3] is not None)}
    fields = spark.createDataFrame(rows, "id long, name string, type string, owner string")
    assert got(derive.schema_mirrors(fields), "src", "dst", "confidence") == sorted(want, key=repr)
    assert derive.schema_mirrors(fields.limit(0)).count() == 0


def test_mirrors_are_not_compared_with_one_another(spark):
    n = 400
    found = derive.schema_mirrors(spark.range(n).selectExpr("id", "'email' AS name", "'str' AS type", "'User' AS owner"))
    assert len({tuple(r) for r in found.collect()}) == n * (n - 1) // 2
    assert rows_out(found, "Exchange", "shuffleRecordsWritten") <= 10 * n


def test_diffs(spark):
    s = "path string, owner string, name string, kind string, content_hash long, id long"
    old = spark.createDataFrame([("f", None, "a", "Function", 1, 1), ("f", None, "b", "Function", 1, 2), ("gone", None, "c", "Function", 1, 3)], s)
    new = spark.createDataFrame([("f", None, "a", "Function", 2, 1), ("f", None, "d", "Function", 1, 4), ("new", None, "e", "Function", 1, 5)], s)
    assert got(diff.symbols(old, new), "name", "status") == [("a", "changed"), ("b", "removed"), ("d", "added")]
    assert diff.symbols(old, old).count() == 0
    r = "method string, path string, file string, line int"
    a, b = spark.createDataFrame([("GET", "/x", "f", 1), ("GET", "/y", "f", 2)], r), spark.createDataFrame([("GET", "/x", "f", 9)], r)
    assert got(diff.routes(a, b), "path", "status") == [("/x", "changed"), ("/y", "removed")]
    v = diff.route_verdicts(spark.createDataFrame([("removed", 0), ("changed", 0), ("changed", 2), ("added", 0)], "status string, consumers int"))
    assert [x["verdict"] for x in v.collect()] == ["Risk", "Warn", "Risk", "Info"]
    ov, ba = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, hash long"), spark.createDataFrame([("a", 1), ("b", 9)], "path string, hash long")
    assert got(diff.promoted(ov, ba), "path") == [("b",), ("c",)]
    assert diff.promoted(ov, ba, diverged=True).count() == 0
    f = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("src/a/index.js",), ("src/b.js",)], "path string")
    assert got(diff.shadowed(f.where("path = 'src/a.ts'"), f), "shadows") == [("src/a.js",), ("src/a/index.js",)]
    assert diff.merged(ov.withColumnRenamed("path", "uid"), ba.withColumnRenamed("path", "uid")).groupBy("uid").count().where("count > 1").count() == 0


def test_routes_and_members(spark):
    m = spark.createDataFrame([("a", True, 5), ("b", True, 5), ("c", False, 0), ("d", True, 1)], "repo string, exists boolean, head_no int")
    s = spark.createDataFrame([("a", 5), ("b", 3)], "repo string, built_no int")
    assert got(routes.member_status(m, s), "repo", "status") == [("a", "Ok"), ("b", "Stale(2)"), ("c", "Missing"), ("d", "NoSnapshot")]
    n = spark.createDataFrame([("get /x",), ("POST /y",)], "name string")
    assert got(routes.listed(n, "GET"), "method", "path") == [("GET", "/x")]


def test_percentile_rule(spark):
    df = spark.createDataFrame([("t", float(x), x != 3) for x in range(1, 11)], "tool string, duration double, ok boolean")
    assert telemetry.by_tool(df).first()[:5] == ("t", 10, 5.0, 9.0, 0.1)
    assert df.agg(telemetry.percentile(F.collect_list("duration"), 50)).first()[0] == 5.0


def test_logs_and_streams(spark, tmp_path):
    lines = ['{"ts": "2024-01-01T00:10:00Z", "tool": "find", "duration_ms": 5, "ok": true}', "broken", '{"ts": "2024-01-01T02:10:00Z"}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    calls = logs.telemetry(spark, str(tmp_path / "t.jsonl"))
    assert got(calls, "tool", "ok") == [("find", True), ("unknown", True)]
    assert [r["calls"] for r in telemetry.hourly(calls).orderBy("hour").collect()] == [1, 0, 1]
    box = tmp_path / "box"
    box.mkdir()
    event = lambda name: json.dumps({"type": "dirty_event", "ts": "t", "peer_session": "p", "symbol": {"name": name}})
    (box / "1.jsonl").write_text("\n".join([event("a"), event("b"), "{oops", event("z")]))
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    run = lambda: inbox.drain(inbox.concerns(inbox.inbox(spark, str(box)), names("a"), names("a", "b")), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    assert got(spark.read.parquet(str(tmp_path / "out")), "name", "concern") == [("a", "HARD"), ("b", "SOFT")]
    (box / "2.jsonl").write_text(event("b"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_ingest_of_python_files(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "a.py").write_text("import os\n\nclass A:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n")
    (tmp_path / "tests" / "test_a.py").write_text("def test_a():\n    helper()\n")
    (tmp_path / "bad.py").write_text("def (:\n")
    g = code.ingest(spark, str(tmp_path))
    assert got(g.nodes, "kind", "name") == [("Class", "A"), ("Function", "helper"), ("Function", "test_a"), ("Method", "run")]
    from weftgraph.cypher import run

    assert got(run(g, "MATCH (a)-[:Calls]->(b) RETURN a.name AS a, b.name AS b"), "a", "b") == [("run", "helper"), ("test_a", "helper")]
    assert got(run(g, "MATCH (c:Class)-[:HasMethod]->(m) RETURN c.name AS c, m.name AS m"), "c", "m") == [("A", "run")]
    assert got(run(g, "MATCH (n {name: 'helper'}) RETURN n.content AS text"), "text") == [("def helper():\n    return 1",)]
    assert g.blind_spots.count() == 1
    seeds = g.nodes.where("name = 'helper'").select(F.col("id").alias("seed"))
    assert traverse.test_coverage(g, seeds).first()["coverage"] == "Covered"
    code.write_snapshot(g, str(tmp_path / "snap"))
    back = code.read_snapshot(spark, str(tmp_path / "snap"), ("nodes", "edges", "files"))
    assert got(back.nodes, "id") == got(g.nodes, "id")
    assert search.find(back, "helper").count() == 1


def test_registered_communities_strand_no_customer(spark, data):
    found = graph_queries.communities(spark, data)
    g = graph_queries.commerce.graph(spark, data)
    assert found.count() == g.nodes.where("kind IN ('Region', 'Nation', 'Customer', 'Supplier')").count()
    edges = g.edges.where("rel_type = 'IN_NATION'")
    c = dict(found.select("id", "community_id").collect())
    stranded = [r for r in edges.select("src", "dst").collect() if c[r["src"]] != c[r["dst"]]]
    print("stranded", len(stranded), "communities", len(set(c.values())), "q", processes.modularity(g.edges.where(graph_queries._INSIDE), found).first()["q"])
    assert not stranded
