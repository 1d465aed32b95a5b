"""From syntax tree to DataFrame.

A node or edge variable ``v`` is bound as flat columns ``v::property``, only those that the query needs, so
Catalyst prunes and pushes down through every join. Logic is two-valued: comparisons never give null.
"""

from __future__ import annotations

import difflib
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.cypher import parser as P
from weftgraph.cypher.parser import CypherError
from weftgraph.operators.traverse import directed, reach
from weftgraph.plans.model import FLAGS, PropertyGraph
from weftgraph.plans.scratch import cut

# Property names of nodes and edges, with their other spellings.
ALIASES = {
    "ownerClass": "owner_class", "startLine": "line", "start_line": "line", "endLine": "end_line", "filePath": "file_path",
    "isTest": "is_test", "isAsync": "is_async", "isStatic": "is_static", "isAbstract": "is_abstract", "isGenerator": "is_generator", "isExtern": "is_extern",
}
NODE_PROPERTIES = ("name", "uid", "owner_class", "kind", "line", "end_line", "file_path", "content", *FLAGS, "visibility", "decorators")
EDGE_PROPERTIES = ("rel_type", "confidence", "reason")
_NODE_SHOWN = (("name", "name"), ("kind", "kind"), ("filePath", "file_path"))


@dataclass(frozen=True)
class Bound:
    """What a name stands for: a node or edge (live, or a value carried past an aggregation), or a computed column."""

    kind: str
    live: bool = True


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "float" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "int"
    return "list" if isinstance(kind, T.ArrayType) else "null" if isinstance(kind, T.NullType) else "other"


def _of(value: object) -> str:
    kinds = {bool: "bool", int: "int", float: "float", str: "text", list: "list"}
    return kinds.get(type(value), "null")


def _conjuncts(x: object) -> list[object]:
    if x is None:
        return []
    return [c for p in x.parts for c in _conjuncts(p)] if isinstance(x, P.Bool) and x.op.upper() == "AND" else [x]


def _names(x: object) -> set[str]:
    """Variables of an expression."""
    if isinstance(x, P.Var):
        return {x.name}
    if isinstance(x, (P.Prop, P.HasLabel)):
        return {x.var}
    if isinstance(x, P.Func):
        return _names(x.arg)
    if isinstance(x, P.Cmp):
        return _names(x.left) | _names(x.right)
    return set().union(*map(_names, x.parts)) if isinstance(x, P.Bool) else set()


class _Compiler:
    def __init__(self, graph: PropertyGraph, query: P.Query, strict: bool):
        self.graph, self.query, self.strict = graph, query, strict
        self.scope: dict[str, Bound] = {}
        self.order: list[str] = []
        self.needs: dict[str, set[str]] = {}
        self.node_columns = {f.name: _family(f.dataType) for f in graph.nodes.schema.fields}
        self._collect(query)
        self.early = self._early()

    def _early(self) -> dict[str, list[object]]:
        """Conjuncts of WHERE by the one variable that they ask for, where a pattern binds it just once.

        They hold for every row that is left in the end, so they may be tested as soon as the variable is bound,
        before a path of variable length starts from it. WHERE itself is still tested in full after all patterns.
        """
        bound: dict[str, int] = {}
        for clause in self.query.matches:
            for nodes, rels in clause.patterns:
                for x in (*nodes, *rels):
                    bound[x.var] = bound.get(x.var, 0) + (2 if clause.optional and clause is not self.query.matches[0] else 1)
        out: dict[str, list[object]] = {}
        for part in _conjuncts(self.query.where):
            names = _names(part)
            if len(names) == 1 and bound.get(name := names.pop()) == 1:
                out.setdefault(name, []).append(part)
        return out

    # --- what each variable is asked for

    def _collect(self, x: object) -> None:
        if isinstance(x, P.Prop):
            self.needs.setdefault(x.var, set()).add(self.property(x.name))
        elif isinstance(x, P.Var):
            self.needs.setdefault(x.name, set()).update({"name", "kind", "file_path", *EDGE_PROPERTIES} if self._returned(x) else {"name"})
        elif isinstance(x, P.HasLabel):
            self.needs.setdefault(x.var, set()).add("kind")
        elif isinstance(x, P.Func):
            if isinstance(x.arg, P.Var) and x.name.lower() in ("type", "id", "labels"):
                self.needs.setdefault(x.arg.name, set()).update({"kind", "rel_type"})
            elif x.arg is not None:
                self._collect(x.arg)
        elif isinstance(x, P.Cmp):
            self._collect(x.left), self._collect(x.right)
        elif isinstance(x, P.Bool):
            [self._collect(p) for p in x.parts]
        elif isinstance(x, P.Item):
            self._collect(x.expr)
        elif isinstance(x, P.Query):
            for part in (x.where, x.with_where, *(x.with_items or ()), *x.items):
                self._collect(part)

    def _returned(self, var: P.Var) -> bool:
        return any(i.expr is var for i in [*(self.query.with_items or ()), *self.query.items])

    def property(self, name: str) -> str:
        known = ALIASES.get(name, name)
        names = {*NODE_PROPERTIES, *EDGE_PROPERTIES, *self.node_columns, "category"}
        if known not in names:
            close = difflib.get_close_matches(name, [*names, *ALIASES], 1)
            warnings.warn(f"unknown property {name}" + (f"; did you mean {close[0]}?" if close else ""), stacklevel=2)
        return known

    # --- patterns

    def nodes(self, pattern: P.NodePattern) -> DataFrame:
        """Scan of the nodes that a pattern allows, with the columns of its variable."""
        needs = self.needs.get(pattern.var, set()) | {self.property(k) for k in pattern.props}
        base = {"line": "start_row", "end_line": "end_row"}
        view = self.graph.node_view({base.get(n, n) for n in needs} | {"id"})
        if pattern.labels:
            kinds = [self.graph.profile.kind(x) for x in pattern.labels]
            if None in kinds:
                raise CypherError(f"unknown node kind {pattern.labels[kinds.index(None)]}")
            view = view.where(F.col("kind").isin(kinds))
        columns = {"line": F.col("start_row") + 1, "end_line": F.col("end_row") + 1}
        for key, value in pattern.props.items():
            view = view.where(self._same(columns.get(self.property(key), self.property(key)), value, view))
        kept = [columns.get(n, F.col(n)).alias(f"{pattern.var}::{n}") if n in columns or n in view.columns else None for n in sorted(needs | {"id"})]
        return view.select(*(c for c in kept if c is not None))

    def _same(self, column: Column | str, value: object, view: DataFrame) -> Column:
        """Typed equality of an inline property: no promotion between kinds of numbers; the text of a node never matches."""
        if column == "content":
            return F.lit(False)
        if isinstance(column, str) and column not in view.columns:
            return F.lit(value is None)
        c = F.col(column) if isinstance(column, str) else column
        kind = "int" if not isinstance(column, str) else _family(view.schema[column].dataType)
        if value is None:
            return c.isNull()
        if column == "owner_class":
            c = F.nullif(c, F.lit(""))
        return c.eqNullSafe(F.lit(value)) if kind == _of(value) and kind != "list" else F.lit(False)

    def edges(self, rel: P.RelPattern) -> DataFrame:
        found = self.graph.edges
        return found.where(F.col("rel_type").isin([self.graph.profile.relation(t) for t in rel.types])) if rel.types else found

    def expand(self, df: DataFrame, left: str, rel: P.RelPattern, right: P.NodePattern) -> DataFrame:
        wanted = sorted(self.needs.get(rel.var, set()) & set(EDGE_PROPERTIES))
        df = df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith((f"{right.var}::", f"{rel.var}::")) or c.startswith(f"{left}::")))
        start, key = F.col(f"{left}::id"), "_start"
        df = df.withColumn(key, start)
        if left == right.var:
            df = df.drop(*(c for c in df.columns if c.startswith(f"{left}::")))
        if rel.span is None:
            ways = directed(self.edges(rel).select("edge_id", "src", "dst", *wanted), rel.direction)
            hops = ways.select(F.col("from").alias(key), F.col("to").alias("_end"), F.col("edge_id").alias(f"{rel.var}::edge_id"), *(self._edge(p, rel.var) for p in wanted))
        else:
            low, high = rel.span
            seeds = df.select(F.col(key).alias("seed"))
            got = reach(seeds, self.edges(rel), rel.direction, high, carry=tuple(wanted)).where(F.col("depth") >= low)
            hops = got.select(F.col("seed").alias(key), F.col("node").alias("_end"), F.col("via").alias(f"{rel.var}::edge_id"), *(self._edge(p, rel.var) for p in wanted))
        df = df.join(hops, key).drop(key)
        ends = self.nodes(right)
        if ends.columns == [f"{right.var}::id"] and not right.labels and not right.props:  # only the id is asked for
            return df.withColumnRenamed("_end", f"{right.var}::id")
        return df.join(ends, F.col("_end") == F.col(f"{right.var}::id")).drop("_end")

    def _edge(self, name: str, var: str) -> Column:
        return (F.col(name).cast("double") if name == "confidence" else F.col(name)).alias(f"{var}::{name}")

    def first(self, prior: DataFrame | None, node: P.NodePattern) -> DataFrame:
        if prior is None:
            return self.nodes(node)
        if f"{node.var}::id" not in prior.columns:
            return prior.crossJoin(self.nodes(node))
        if not node.labels and not node.props:
            return prior
        return prior.join(self.nodes(node).select(f"{node.var}::id"), f"{node.var}::id", "left_semi")

    def pattern(self, prior: DataFrame | None, nodes: list[P.NodePattern], rels: list[P.RelPattern]) -> DataFrame:
        df = self.first(prior, nodes[0])
        self.bind(nodes[0].var, "node")
        df = self.sifted(df, nodes[0].var)
        for left, rel, right in zip(nodes, rels, nodes[1:], strict=False):
            df = self.expand(df, left.var, rel, right)
            self.bind(rel.var, "edge")
            self.bind(right.var, "node")
            df = self.sifted(self.sifted(df, rel.var), right.var)
        return df

    def sifted(self, df: DataFrame, var: str) -> DataFrame:
        """The rows that may still pass WHERE once ``var`` is bound."""
        for part in self.early.get(var, ()):
            df = df.where(self.truth(part, df))
        return df

    def bind(self, var: str, kind: str) -> None:
        self.scope[var] = Bound(kind)
        if var not in self.order:
            self.order.append(var)

    def match(self, prior: DataFrame | None, clause: P.Match) -> DataFrame:
        if prior is None and clause.optional:
            clause = P.Match(False, clause.patterns)
        if clause.optional:
            return self.optional(prior, clause)
        if self.strict:
            for nodes, rels in clause.patterns:
                prior = self.pattern(prior, nodes, rels)
            return prior
        # Comma patterns: each extends what was there before, and their results follow one another.
        found = [self.pattern(prior, nodes, rels) for nodes, rels in clause.patterns]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    def optional(self, prior: DataFrame, clause: P.Match) -> DataFrame:
        nodes, rels = clause.patterns[0]
        key = f"{nodes[0].var}::id"
        if len(clause.patterns) == 1 and key in prior.columns:
            mine = {n.var for n in nodes[1:]} | {r.var for r in rels}
            seeds = prior.select(F.col(f"`{key}`")).where(F.col(key).isNotNull()).distinct()
            found = self.pattern(seeds, nodes, rels)
            old = [c for c in prior.columns if c.split("::")[0] not in mine]
            return prior.select(*(F.col(f"`{c}`") for c in old)).join(found, key, "left")
        rows = cut(prior.withColumn("_row", F.monotonically_increasing_id()), "optional")
        out = None
        for nodes, rels in clause.patterns:
            df = self.pattern(rows, nodes, rels)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        new = [c for c in out.columns if c not in rows.columns]
        return rows.join(out.select("_row", *(F.col(f"`{c}`") for c in new)), "_row", "left").drop("_row")

    # --- expressions: (column, family)

    def value(self, x: object, df: DataFrame) -> tuple[Column, str]:
        if isinstance(x, P.Lit):
            return (F.array(*map(F.lit, x.value)) if isinstance(x.value, list) else F.lit(x.value)), _of(x.value)
        if isinstance(x, (P.Prop, P.Var)):
            var = x.var if isinstance(x, P.Prop) else x.name
            bound = self.scope.get(var)
            if isinstance(x, P.Var) and bound and bound.kind == "value":
                return self.column(var, df)
            if isinstance(x, P.Var) and bound and bound.kind == "edge":
                return self.column(f"{var}::edge_id", df)
            return self.column(f"{var}::{self.property(x.name) if isinstance(x, P.Prop) else 'name'}", df)
        if isinstance(x, P.Func):
            return self.function(x, df)
        return self.truth(x, df), "bool"

    def column(self, name: str, df: DataFrame) -> tuple[Column, str]:
        if name not in df.columns:
            return F.lit(None), "null"
        c = F.col(f"`{name}`")
        return (F.nullif(c, F.lit("")) if name.endswith("::owner_class") else c), _family(df.schema[name].dataType)

    def function(self, x: P.Func, df: DataFrame) -> tuple[Column, str]:
        name, var = x.name.lower(), x.arg.name if isinstance(x.arg, P.Var) else None
        bound = self.scope.get(var)
        if bound and bound.live:
            if name == "type" and bound.kind == "edge":
                return self.column(f"{var}::rel_type", df)
            if name == "id" and bound.kind == "node":
                return self.column(f"{var}::id", df)
            if name == "labels" and bound.kind == "node":
                kind, _ = self.column(f"{var}::kind", df)
                return F.when(kind.isNotNull(), F.array(kind)), "list"
        return F.lit(None), "null"

    def truth(self, x: object, df: DataFrame) -> Column:
        """A predicate as a column that is never null."""
        if isinstance(x, P.Bool):
            parts = [self.truth(p, df) for p in x.parts]
            if x.op == "NOT":
                return ~parts[0]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if x.op == "AND" else (out | p)
            return out
        if isinstance(x, P.HasLabel):
            bound = self.scope.get(x.var)
            if not bound or bound.kind != "node" or not bound.live:
                return F.lit(False)
            return F.coalesce(self.column(f"{x.var}::kind", df)[0].isin(list(x.labels)), F.lit(False))
        if isinstance(x, P.Cmp):
            return self.compare(x, df)
        if isinstance(x, P.Func):
            raise CypherError(f"{x.name}() cannot be used in WHERE")
        c, kind = self.value(x, df)
        return F.coalesce(c, F.lit(False)) if kind == "bool" else c.isNotNull()

    def compare(self, x: P.Cmp, df: DataFrame) -> Column:
        for side in (x.left, x.right):
            if isinstance(side, P.Func):
                raise CypherError(f"{side.name}() cannot be used in WHERE")
        if x.op in ("=", "<>") and any(isinstance(a, P.Prop) and a.name == "uid" and isinstance(b, P.Lit) and isinstance(b.value, str) for a, b in ((x.left, x.right), (x.right, x.left))):
            raise CypherError("uid is a number; compare it with a number")
        (a, ka), (b, kb) = self.value(x.left, df), self.value(x.right, df) if x.op != "IN" or not isinstance(x.right, P.Lit) else (None, "list")
        no = lambda c: F.coalesce(c, F.lit(False))
        if x.op == "IN":
            if isinstance(x.right, P.Lit):
                hits = [self._equal(a, ka, F.lit(v), _of(v)) for v in x.right.value]
                out = F.lit(False)
                for h in hits:
                    out = out | h
                return out
            return no(F.array_contains(b, a)) if kb == "list" else F.lit(False)
        if x.op == "=":
            return self._equal(a, ka, b, kb)
        if x.op == "<>":
            return ~self._equal(a, ka, b, kb)
        if x.op in ("STARTS", "ENDS", "CONTAINS", "=~"):
            if ka != "text" or kb != "text":
                return F.lit(False)
            if x.op == "=~":
                try:
                    re.compile(x.right.value) if isinstance(x.right, P.Lit) else None
                except re.error as e:
                    raise CypherError(f"bad pattern: {e}") from e
                return no(a.rlike(x.right.value) if isinstance(x.right, P.Lit) else F.rlike(a, b))
            return no({"STARTS": a.startswith, "ENDS": a.endswith, "CONTAINS": a.contains}[x.op](b))
        numbers = ("int", "float")
        if not (ka == kb == "text" or (ka in numbers and kb in numbers)):
            return F.lit(False)
        return no({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op])

    def _equal(self, a: Column, ka: str, b: Column, kb: str) -> Column:
        """Nulls are equal to each other; lists never are."""
        if "list" in (ka, kb):
            return F.lit(False)
        if "null" in (ka, kb):
            return (a if kb == "null" else b).isNull() if ka != kb else F.lit(True)
        numbers = ("int", "float")
        return a.eqNullSafe(b) if ka == kb or (ka in numbers and kb in numbers) else a.isNull() & b.isNull()

    # --- projection

    def label(self, item: P.Item) -> str:
        x = item.alias or item.expr
        if isinstance(x, str):
            return x
        return f"{x.var}.{x.name}" if isinstance(x, P.Prop) else x.name if isinstance(x, P.Var) else f"{x.name.upper()}(*)" if isinstance(x, P.Func) and x.name.upper() in P.AGGREGATES else f"{x.name}({getattr(x.arg, 'name', '*')})" if isinstance(x, P.Func) else "expr"

    def is_aggregate(self, item: P.Item) -> bool:
        return isinstance(item.expr, P.Func) and item.expr.name.upper() in P.AGGREGATES

    def expanded(self, items: list[P.Item]) -> list[P.Item]:
        """A bare node or edge becomes its three columns."""
        out = []
        for i in items:
            bound = self.scope.get(i.expr.name) if isinstance(i.expr, P.Var) and not i.alias else None
            if bound and bound.kind in ("node", "edge"):
                shown = _NODE_SHOWN if bound.kind == "node" else [(p, p) for p in EDGE_PROPERTIES]
                out += [P.Item(P.Prop(i.expr.name, p), f"{i.expr.name}.{title}") for title, p in shown]
            else:
                out.append(i)
        return out

    def aggregate(self, x: P.Func, df: DataFrame) -> Column:
        name = x.name.upper()
        if x.arg is None:
            return F.count(F.lit(1)) if name == "COUNT" else F.lit(None)
        c, kind = self.value(x.arg, df)
        numeric = kind in ("int", "float")
        if name == "COUNT":
            return F.count_distinct(c) if x.distinct else F.count(c)
        if name == "SUM":
            return F.coalesce(F.sum(c), F.lit(0)) if numeric else F.sum(F.lit(0))
        if name == "AVG":
            return F.avg(c.cast("double")) if numeric else F.max(F.lit(None).cast("double"))
        if name in ("MIN", "MAX"):
            return (F.min if name == "MIN" else F.max)(c) if kind != "null" else F.max(F.lit(None).cast("string"))
        place = F.struct(*(F.col(f"`{v}::{k}`").alias(f"k{n}") for n, (v, k) in enumerate((v, "edge_id" if self.scope.get(v, Bound("")).kind == "edge" else "id") for v in self.order) if f"{v}::{k}" in df.columns), F.lit(0).alias("z"))
        rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(place.alias("place"), c.alias("v")))))
        listed = F.transform(rows, lambda r: r["v"])
        return F.array_distinct(listed) if x.distinct else listed

    def grouped(self, df: DataFrame, items: list[P.Item], default_row: bool) -> tuple[DataFrame, list[str]]:
        """Aggregates by the other items; columns are named g0, g1, ... in the order of the items."""
        keys = [(f"g{k}", self.result(i, df)) for k, i in enumerate(items) if not self.is_aggregate(i)]
        aggs = [self.aggregate(i.expr, df).alias(f"g{k}") for k, i in enumerate(items) if self.is_aggregate(i)]
        out = df.groupBy(*(c.alias(n) for n, c in keys)).agg(*aggs) if keys else df.agg(*aggs)
        if not keys and not default_row:  # WITH over no rows gives no row
            out = df.agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n > 0")
        return out, [f"g{k}" for k in range(len(items))]

    def result(self, item: P.Item, df: DataFrame) -> Column:
        bound = self.scope.get(item.expr.name) if isinstance(item.expr, P.Var) else None
        if bound and bound.kind == "edge" and item.alias:
            return F.lit(None)
        return self.value(item.expr, df)[0]

    def with_clause(self, df: DataFrame) -> DataFrame:
        items = self.query.with_items
        if not any(map(self.is_aggregate, items)):
            values = [(i, self.label(i)) for i in items if not (isinstance(i.expr, P.Var) and self.scope.get(i.expr.name, Bound("value")).kind != "value" and not i.alias)]
            renamed = [(i.expr.name, i.alias) for i in items if isinstance(i.expr, P.Var) and i.alias and self.scope.get(i.expr.name, Bound("value")).kind != "value"]
            df = df.select("*", *(F.col(f"`{c}`").alias(f"{new}::{c.split('::')[1]}") for old, new in renamed for c in df.columns if c.startswith(f"{old}::")), *(self.value(i.expr, df)[0].alias(n) for i, n in values if (i.expr.name if isinstance(i.expr, P.Var) else None) not in {o for o, _ in renamed}))
            for old, new in renamed:
                self.scope[new] = self.scope[old]
            for _, n in values:
                if n not in self.scope:
                    self.scope[n] = Bound("value")
        else:
            carried = [i for i in items if isinstance(i.expr, P.Var) and self.scope.get(i.expr.name, Bound("value")).kind in ("node", "edge")]
            plain = [i for i in items if i not in carried]
            keys, lasting = [], {}
            for i in carried:  # a node or edge is grouped by its identity and keeps its properties as a value
                var, name = i.expr.name, i.alias or i.expr.name
                kind = self.scope[var].kind
                key = f"{var}::{'id' if kind == 'node' else 'edge_id'}"
                keys += [F.col(f"`{key}`").alias(f"{name}::{key.split('::')[1]}")]
                keys += [F.col(f"`{c}`").alias(f"{name}::{c.split('::')[1]}") for c in df.columns if c.startswith(f"{var}::") and c != key]
                lasting[name] = Bound(kind, live=False)
            keys += [self.result(i, df).alias(self.label(i)) for i in plain if not self.is_aggregate(i)]
            aggs = [self.aggregate(i.expr, df).alias(self.label(i)) for i in plain if self.is_aggregate(i)]
            df = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
            self.scope = lasting | {self.label(i): Bound("value") for i in plain}
            self.order = list(lasting)
        if self.query.with_distinct:
            df = df.distinct()
        return df.where(self.truth(self.query.with_where, df)) if self.query.with_where is not None else df

    def compile(self) -> DataFrame:
        q = self.query
        df: DataFrame | None = None
        for clause in q.matches:
            df = self.match(df, clause)
        if q.where is not None:
            df = df.where(self.truth(q.where, df))
        if q.with_items is not None:
            df = self.with_clause(df)
        items = self.expanded(q.items)
        titles = [self.label(i) for i in items]
        if any(map(self.is_aggregate, items)):
            out, _ = self.grouped(df, items, default_row=True)
            out = out.select(*(F.col(f"g{k}").alias(t) for k, t in enumerate(titles)))
        else:
            out = df.select(*(self.result(i, df).alias(t) for i, t in zip(items, titles, strict=True)))
        if q.distinct:
            out = out.distinct()
        keys = [(t, up) for t, up in q.order_by if t in titles]
        if keys:
            out = out.orderBy(*(F.col(f"`{t}`").asc_nulls_first() if up else F.col(f"`{t}`").desc_nulls_last() for t, up in keys))
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        if q.union:
            keep_all, right = q.union
            other = _Compiler(self.graph, right, self.strict).compile()
            if len(other.columns) != len(out.columns):
                raise CypherError("both sides of UNION need the same number of columns")
            out = out.union(other)
            out = out if keep_all else out.distinct()
        return out


def run(graph: PropertyGraph, text: str, strict: bool = False) -> DataFrame:
    """The result of a query, lazily but for paths of variable length, whose levels are written as they are found. ``strict`` makes comma patterns a product, as in the standard language."""
    return _Compiler(graph, P.parse(text), strict).compile()


def shaped(df: DataFrame) -> dict:
    """{columns, rows} of a small result; a single column gives plain values."""
    rows = [list(r) for r in df.collect()]
    return {"columns": df.columns, "rows": [r[0] for r in rows] if len(df.columns) == 1 else rows}
