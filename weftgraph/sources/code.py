"""Snapshots of code graphs, and the ingest of source files. Python is parsed with the standard library's ``ast``."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import file_category, language
from weftgraph.plans.model import PropertyGraph

TABLES = ("nodes", "edges", "files", "function_meta", "call_meta", "route_shapes", "blind_spots", "processes", "sources")
#: Larger files are left out of the ingest, as an input rule.
MAX_BYTES = 16 << 20


def write_snapshot(graph: PropertyGraph, path: str) -> None:
    """One Parquet folder per table; nodes are partitioned by kind, so scans of a label read only its files."""
    for name in TABLES:
        df = getattr(graph, name)
        if df is not None:
            writer = df.write.mode("overwrite")
            (writer.partitionBy("kind") if name == "nodes" else writer).parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, tables: tuple[str, ...] = ("nodes", "edges")) -> PropertyGraph:
    """The named tables of a snapshot."""
    return PropertyGraph(**{t: spark.read.parquet(f"{path}/{t}") for t in tables})


def read_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """(file_id, path, text, content_hash, category, language) of the source files under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_BYTES)
    rel = F.regexp_replace("path", r"^\w+:/*", "/")
    out = found.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"), F.xxhash64("content").alias("content_hash"))
    return out.select(F.xxhash64("path").alias("file_id"), "path", "text", "content_hash", file_category(F.col("path")).alias("category"), language(F.col("path")).alias("language"))


_SYMBOLS = "file_id long, what string, kind string, name string, owner string, start_row int, start_col int, end_row int, end_col int, decorators array<string>, is_async boolean"


class _Visitor(ast.NodeVisitor):
    """Symbols, calls, imports and bases of a module, in one list of rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.owners: list[str] = []
        self.functions: list[str] = []

    def add(self, what: str, kind: str, name: str, node: ast.AST, decorators: tuple = (), is_async: bool = False) -> None:
        owner = self.functions[-1] if what in ("call", "import") and self.functions else self.owners[-1] if self.owners else None
        self.rows.append((what, kind, name, owner, node.lineno - 1, node.col_offset, (node.end_lineno or node.lineno) - 1, node.end_col_offset or 0, [ast.unparse(d) for d in decorators], is_async))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("symbol", "Class", node.name, node, tuple(node.decorator_list))
        for base in node.bases:
            self.rows.append(("base", "Class", ast.unparse(base).rsplit(".", 1)[-1], node.name, node.lineno - 1, 0, 0, 0, [], False))
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def _function(self, node, is_async: bool) -> None:
        kind = "Constructor" if node.name == "__init__" and self.owners else "Method" if self.owners else "Function"
        self.add("symbol", kind, node.name, node, tuple(node.decorator_list), is_async)
        self.functions.append(node.name)
        self.generic_visit(node)
        self.functions.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, False)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, True)

    def visit_Call(self, node: ast.Call) -> None:
        name = ast.unparse(node.func).rsplit(".", 1)[-1]
        if name.isidentifier():
            self.add("call", "Function", name, node)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", "Import", a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", "Import", f"{node.module or ''}.{a.name}".lstrip("."), node)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _SYMBOLS.split(", ")]
    for batch in batches:
        rows = []
        for file_id, text in zip(batch["file_id"], batch["text"], strict=True):
            visitor = _Visitor()
            try:
                visitor.visit(ast.parse(text))
            except (SyntaxError, ValueError, RecursionError):  # a file that is not the language is a blind spot
                visitor.rows = [("blind", "parse-error", "", None, 0, 0, 0, 0, [], False)]
            rows += [(file_id, *r) for r in visitor.rows]
        yield pd.DataFrame(rows, columns=names)


def parse(files: DataFrame) -> DataFrame:
    """Rows of symbols, calls, imports, bases and blind spots of Python files."""
    return files.where(F.col("language") == "python").select("file_id", "text").mapInPandas(_parsed, _SYMBOLS)


def ingest(spark: SparkSession, path: str, glob: str = "*.py") -> PropertyGraph:
    """A code graph of the Python files under a folder: parsed, resolved by the cascade, with derived edges."""
    from weftgraph.operators import derive
    from weftgraph.plans.scratch import cut

    files = cut(read_files(spark, path, glob), "files")
    raw = cut(parse(files), "parsed")
    named = raw.where("what = 'symbol'").join(files.select("file_id", "path"), "file_id")
    nodes = named.select(F.xxhash64("file_id", "kind", "owner", "name", "start_row", "start_col").alias("id"), "name", "kind", "file_id", "path", F.col("owner").alias("owner_class"), "start_row", "start_col", "end_row", "end_col", F.lit(0).alias("community_id"), F.col("file_id").alias("content_hash"), "decorators", "is_async")
    nodes = cut(derive.with_uids(nodes), "nodes")
    owners = nodes.select("file_id", F.col("name").alias("owner"), F.col("id").alias("src"), "kind").where(F.col("kind").isin("Function", "Method", "Constructor")).groupBy("file_id", "owner").agg(F.min("src").alias("src"))
    calls = raw.where("what = 'call'").join(owners, ["file_id", "owner"]).select("src", "file_id", "name").distinct()
    refs = calls.select(F.xxhash64("src", "name").alias("ref_id"), "src", "file_id", "name", F.lit(None).cast("string").alias("qualifier"), F.lit(None).cast("string").alias("owner"), F.lit("python").alias("language"))
    symbols = nodes.select("id", "file_id", "name", F.col("owner_class").alias("owner"), F.lit("python").alias("language"))
    resolved = derive.resolve(refs.drop("src"), symbols).join(refs.select("ref_id", "src"), "ref_id")
    edge = lambda df, rel, sure: df.select("src", "dst", F.lit(rel).alias("rel_type") if isinstance(rel, str) else rel, sure.cast("float").alias("confidence"))
    edges = edge(resolved.withColumnRenamed("id", "dst"), "Calls", F.col("confidence")).unionByName(edge(derive.membership(nodes), F.col("rel_type"), F.lit(1.0)))
    edges = edges.select(F.xxhash64("src", "dst", "rel_type").alias("edge_id"), "src", "dst", "rel_type", "confidence", F.lit("ast").alias("reason"))
    meta = nodes.select(F.col("id").alias("node_id"), F.col("name").startswith("test_").alias("is_test"), "is_async", *(F.lit(False).alias(f"is_{x}") for x in ("static", "abstract", "generator", "extern")), F.when(F.col("name").startswith("_"), 2).otherwise(0).alias("visibility"), F.array().cast("array<struct<name:string,type:string>>").alias("params"), F.lit(None).cast("string").alias("return_type"), "decorators")
    spots = raw.where("what = 'blind'").join(files.select("file_id", "path"), "file_id").select("kind", F.col("path").alias("file_path"), "start_row", "start_col", "end_row", "end_col", F.lit("python:parse").alias("hint"), F.lit(False).alias("is_test"))
    return PropertyGraph(nodes.drop("path", "decorators", "is_async"), edges, files=files.select("file_id", "path", F.lit(0).cast("long").alias("mtime"), "content_hash", "category", "language"), function_meta=meta, blind_spots=spots, sources=files.select("file_id", "text"))
