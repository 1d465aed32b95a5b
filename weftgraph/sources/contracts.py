"""Contracts that source files provide: HTTP routes and gRPC services, by a registry of extractors.

An extractor reads the text of one language and gives an array of items, as a column expression, so that all of them run
in one pass over the files. Texts are matched by pattern, not parsed: what stands in a comment counts, and of several
handlers of one route only the first is named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.routes import contract_links, registry

ITEM = "struct<contract_id:string,name:string,symbol:string,confidence:float,meta:map<string,string>>"

# Endings of files by language, verbs by the names that stand for them, and confidences.
LANGUAGES = {"go": "go", "py": "python", "ts": "node", "tsx": "node", "js": "node", "jsx": "node", "java": "java", "rs": "rust"}
VERBS = ["get", "post", "put", "delete", "patch"]
PLAIN = {v: v.upper() for v in VERBS}
GO = {"HandleFunc": "ANY", "Handle": "ANY"} | {v.upper(): v.upper() for v in VERBS} | {v.title(): v.upper() for v in VERBS}
SPRING = {f"{v.title()}Mapping": v.upper() for v in VERBS} | {"RequestMapping": "ANY"}
ROUTE_CONFIDENCE, SERVICE_CONFIDENCE = 0.85, 0.9


@dataclass(frozen=True)
class Extractor:
    """``find`` turns a column of texts of the language into an array of ``ITEM``."""

    language: str
    kind: str
    find: Callable[[Column], Column]


REGISTRY: list[Extractor] = []


def register(language: str, kind: str):
    """Add a function to the extractors that are used by default."""

    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        REGISTRY.append(Extractor(language, kind, f))
        return f

    return add


def _found(text: Column, pattern: str, *groups: int) -> Column:
    """An array with a struct (a, b, ...) of the groups of each match."""
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.arrays_zip(*each).cast("array<struct<" + ",".join(f"{n}:string" for n in "abcd"[: len(groups)]) + ">>")


def _route(verb: Column, path: Column, handler: Column) -> Column:
    name = F.when(handler == "", "<unknown>").otherwise(handler)
    return F.struct(F.concat(F.lit("http:"), verb, F.lit(":"), path), name, name, F.lit(ROUTE_CONFIDENCE), F.create_map(F.lit("method"), verb)).cast(ITEM)


def _routes(text: Column, pattern: str, verbs: dict[str, str], order: tuple[int, int, int] = (1, 2, 3)) -> Column:
    """Routes by the groups of verb, path and handler."""
    table = F.create_map(*(F.lit(x) for kv in verbs.items() for x in kv))
    return F.transform(_found(text, pattern, *order), lambda m: _route(F.try_element_at(table, m["a"]), m["b"], m["c"]))


def _services(text: Column, pattern: str, name: str, symbol: str) -> Column:
    """Services by the one group; ``{}`` stands for it in the name and in the symbol."""

    def filled(form: str, service: Column) -> Column:
        return F.replace(F.lit(form), F.lit("{}"), service)

    def item(m: Column) -> Column:
        service = m["a"]
        return F.struct(F.concat(F.lit("grpc:"), service, F.lit(":*")), filled(name, service), filled(symbol, service), F.lit(SERVICE_CONFIDENCE), F.create_map(F.lit("service"), service)).cast(ITEM)

    return F.transform(_found(text, pattern, 1), item)


def _one_of(names: dict[str, str]) -> str:
    return "(" + "|".join(sorted(names, key=len, reverse=True)) + ")"


@register("go", "http")
def go_routes(text: Column) -> Column:
    """``mux.HandleFunc("/path", handler)`` and calls named by a verb."""
    return _routes(text, rf'\.{_one_of(GO)}\(\s*"([^"\n]*)"\s*,\s*([\w.]*)', GO)


@register("node", "http")
def node_routes(text: Column) -> Column:
    """``app.get("/path", handler)``."""
    verbs = PLAIN | {"all": "ANY"}
    return _routes(text, rf"\.{_one_of(verbs)}\(\s*[\"']([^\"'\n]+)[\"']\s*,\s*(\w*)", verbs)


@register("java", "http")
def java_routes(text: Column) -> Column:
    """``@GetMapping("/path")`` on a method; on a class it gives no route."""
    method = r"(?=(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\()"
    return _routes(text, rf'@{_one_of(SPRING)}\(\s*"([^"\n]+)"\s*\){method}', SPRING)


@register("rust", "http")
def rust_routes(text: Column) -> Column:
    """``.route("/path", get(handler))``, and ``#[get("/path")]`` before a function."""
    verbs = PLAIN | {"any": "ANY"}
    chained = _routes(text, rf'\.route\(\s*"([^"\n]+)"\s*,\s*{_one_of(verbs)}\(\s*(\w+)\s*\)', verbs, (2, 1, 3))
    marked = _routes(text, rf'#\[\s*{_one_of(verbs)}\(\s*"([^"\n]+)"(?:(?=[\s\S]*?\bfn\s+(\w+)))?', verbs)
    return F.concat(chained, marked)


@register("python", "http")
def python_routes(text: Column) -> Column:
    """Decorators named by a verb, and ``route`` with its methods; a function's first path counts for all its methods."""
    pattern = rf"@[\w.]+\.({'|'.join(VERBS)}|route)\(\s*[\"']([^\"'\n]+)[\"']([^()]*)(?=[\s\S]*?\n[ \t]*(?:async[ \t]+)?((?:def|class)[ \t]+\w+))"
    marks = F.filter(_found(text, pattern, 1, 2, 3, 4), lambda m: m["d"].startswith("def"))
    name = lambda m: F.regexp_extract(m["d"], r"(\w+)$", 1)
    plain = F.transform(F.filter(marks, lambda m: m["a"] != "route"), lambda m: _route(F.upper(m["a"]), m["b"], name(m)))
    listed = F.filter(marks, lambda m: m["a"] == "route")

    def methods(rows: Column) -> Column:
        lists = F.transform(rows, lambda m: F.regexp_extract(m["c"], r"\bmethods\s*=\s*[\[]([^\]]*)", 1))
        return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.upper(x), F.lit("[\"']([^\"']+)[\"']"), F.lit(1)))))

    def of_function(f: Column) -> Column:
        rows = F.filter(listed, lambda m: m["d"] == f)
        found, first = methods(rows), F.get(rows, 0)
        return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ANY"))), lambda verb: _route(verb, first["b"], name(first)))

    return F.concat(plain, F.flatten(F.transform(F.array_distinct(F.transform(listed, lambda m: m["d"])), of_function)))


@register("go", "grpc")
def go_services(text: Column) -> Column:
    return _services(text, r"\.Register(\w+)Server\(", "Register{}Server", "Register{}Server")


@register("python", "grpc")
def python_services(text: Column) -> Column:
    return _services(text, r"\.add_(\w+)Servicer_to_server\(", "add_{}Servicer_to_server", "add_{}Servicer_to_server")


@register("node", "grpc")
def node_services(text: Column) -> Column:
    return _services(text, r"\.addService\(\s*(?:[\w$]+\.)+([\w$]+)\.service\b", "addService", "addService::{}")


@register("java", "grpc")
def java_services(text: Column) -> Column:
    return _services(text, r"\baddService\(\s*new\s+\w+\.(\w+)ImplBase\b", "addService", "addService::{}ImplBase")


@register("rust", "grpc")
def rust_services(text: Column) -> Column:
    return _services(text, r"\.add_service\(\s*(?:\w+::)+(\w+)Server::new\(", "add_service", "add_service::{}Server")


def extracted(files: DataFrame, extractors: list[Extractor] | None = None) -> DataFrame:
    """(repo, contract_id, contract_type, role, symbol, file_path, symbol_name, confidence, meta) of files (repo, path, text), in one pass."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    typed = files.select("repo", "path", "text", F.try_element_at(table, F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("language")).where("language IS NOT NULL")
    none = F.array().cast(f"array<struct<kind:string,item:{ITEM}>>")
    each = []
    for x in REGISTRY if extractors is None else extractors:
        kind = F.lit(x.kind)
        tagged = F.transform(x.find(F.col("text")), lambda item: F.struct(kind.alias("kind"), item.alias("item")))  # noqa: B023
        each.append(F.when((F.col("language") == x.language) & F.col("text").isNotNull(), tagged).otherwise(none))
    items = typed.select("repo", "path", F.explode(F.concat(none, *each)).alias("x"))
    symbol = F.concat("path", F.lit("::"), "x.item.symbol")
    return items.select("repo", "x.item.contract_id", F.col("x.kind").alias("contract_type"), F.lit("provider").alias("role"), symbol.alias("symbol"), F.col("path").alias("file_path"), F.col("x.item.name").alias("symbol_name"), "x.item.confidence", "x.item.meta")


def synced(files: DataFrame, members: DataFrame, path: str, consumers: DataFrame | None = None, min_score: float = 0.6, exact_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contracts, links, missing) of a group: what the files of its members (repo) provide, written under ``path`` and linked.

    ``consumers`` are contracts of the same form that members ask for; members without any file are missing.
    """
    own = files.join(members.select("repo").distinct(), "repo", "left_semi")
    contracts = extracted(own)
    contracts = contracts.unionByName(consumers) if consumers is not None else contracts
    contracts.write.mode("overwrite").parquet(f"{path}/contracts")
    stored = files.sparkSession.read.parquet(f"{path}/contracts")
    links = contract_links(stored.select("repo", "contract_id", "role", "symbol"), min_score, exact_only=exact_only)
    stored, links = registry(path, links=links, spark=files.sparkSession)
    return stored, links, members.select("repo").distinct().join(files.select("repo").distinct(), "repo", "left_anti")
