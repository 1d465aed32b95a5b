"""The property-graph model: typed nodes and confidence-weighted edges as DataFrames, with side tables.

A profile names the kinds and relations of a domain and the roles that operators need to know: which relations
are heuristic (guessed) and which express containment (no influence flows along them).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "id long, uid long, name string, kind string, file_id long, owner_class string, start_row int, start_col int, end_row int, end_col int, community_id int, content_hash long"
EDGES = "edge_id long, src long, dst long, rel_type string, confidence float, reason string"
FILES = "file_id long, path string, mtime long, content_hash long, category string, language string"
FUNCTION_META = "node_id long, is_test boolean, is_async boolean, is_static boolean, is_abstract boolean, is_generator boolean, is_extern boolean, visibility int, params array<struct<name:string,type:string>>, return_type string, decorators array<string>"
CALL_META = "edge_id long, is_direct boolean, is_dynamic_dispatch boolean, is_callback boolean, is_constructor boolean, dispatch_type string"
ROUTE_SHAPES = "node_id long, response_keys array<string>, error_keys array<string>"
BLIND_SPOTS = "kind string, file_path string, start_row int, start_col int, end_row int, end_col int, hint string, is_test boolean"
PROCESSES = "process_id long, label string, entry_id long, terminal_id long, steps array<long>, communities array<int>, process_type string"

# The code profile's vocabularies.
NODE_KINDS = "File Function Class Method Interface Constructor Property Variable Const Import Route Process Document Section EntryPoint Struct Enum Typedef Namespace Module Macro Annotation Trait Impl SchemaField EventTopic TransactionScope EnumVariant PathLiteral".split()
REL_TYPES = "Defines Imports Calls Extends Implements HasMethod HasProperty Accesses HandlesRoute StepInProcess References Fetches MirrorsField Publishes Subscribes EventTopicMirror OpensTxScope Overrides Decorates UsesPathLiteral ReadsField CompensatedBy QueriesTable".split()
BLIND_KINDS = {
    "c": "c-dlsym",
    "cpp": "cpp-dlsym",
    "c_sharp": "cs-activator-create-instance cs-method-invoke",
    "dart": "dart-function-apply dart-mirrors-import",
    "go": "go-reflect-method-by-name go-plugin-open",
    "java": "java-class-forname java-method-invoke",
    "javascript": "js-eval js-function-ctor js-dynamic-import js-dynamic-require",
    "kotlin": "kt-class-forname kt-method-invoke",
    "php": "php-eval php-call-user-func php-variable-call",
    "python": "python-eval python-exec python-compile python-dynamic-import python-builtin-import python-cross-getattr",
    "ruby": "rb-eval rb-instance-eval rb-send",
    "rust": "rs-transmute-fn rs-libloading-get",
    "swift": "swift-nsclass-from-string swift-perform-selector",
    "typescript": "ts-eval ts-function-ctor ts-dynamic-import ts-dynamic-require",
}
INDIRECT_LANGUAGES = "c cpp javascript python rust typescript".split()
FORMAT_VERSION = 12
FLAGS = "is_test is_async is_static is_abstract is_generator is_extern".split()


@dataclass(frozen=True)
class Profile:
    """Vocabulary of a domain. ``aliases`` maps other spellings of property names to columns."""

    kinds: tuple[str, ...]
    relations: tuple[str, ...]
    heuristic: frozenset[str] = frozenset()
    containment: frozenset[str] = frozenset()
    kind_aliases: dict[str, str] = field(default_factory=dict)

    def kind(self, name: str) -> str | None:
        by_lower = {k.lower(): k for k in self.kinds} | self.kind_aliases
        return by_lower.get(name.lower())

    def relation(self, name: str) -> str:
        """CamelCase, UPPER_SNAKE and lower spellings mean the same relation."""
        plain = name.replace("_", "").lower()
        return next((r for r in self.relations if r.replace("_", "").lower() == plain), name)


CODE = Profile(
    tuple(NODE_KINDS), tuple(REL_TYPES),
    frozenset({"MirrorsField", "EventTopicMirror", "CompensatedBy"}),
    frozenset({"Defines", "HasMethod", "HasProperty", "Imports"}),
    {"mod": "Module", "protocol": "Interface", "typealias": "Typedef", "var": "Variable", "fn": "Function", "func": "Function"},
)


@dataclass(frozen=True)
class PropertyGraph:
    """One immutable snapshot. Side tables are optional; absent ones read as empty."""

    nodes: DataFrame
    edges: DataFrame
    profile: Profile = CODE
    files: DataFrame | None = None
    function_meta: DataFrame | None = None
    call_meta: DataFrame | None = None
    route_shapes: DataFrame | None = None
    blind_spots: DataFrame | None = None
    processes: DataFrame | None = None
    sources: DataFrame | None = None

    def side(self, name: str) -> DataFrame:
        found = getattr(self, name)
        schema = {"files": FILES, "function_meta": FUNCTION_META, "call_meta": CALL_META, "route_shapes": ROUTE_SHAPES, "blind_spots": BLIND_SPOTS, "processes": PROCESSES, "sources": "file_id long, text string"}[name]
        return found if found is not None else self.nodes.sparkSession.createDataFrame([], T._parse_datatype_string(schema))

    def node_view(self, needs: set[str] | None = None) -> DataFrame:
        """Nodes with the path, metadata and text that a query needs (all but the text by default); no other side table is joined."""
        view = self.nodes
        wants = lambda *names: needs is None or bool(needs & set(names))
        for name, kind in (("uid", "long"), ("file_id", "long"), ("owner_class", "string"), ("start_row", "int"), ("start_col", "int"), ("end_row", "int"), ("end_col", "int"), ("community_id", "int"), ("content_hash", "long")):
            if name not in self.nodes.columns:
                view = view.withColumn(name, F.lit(None).cast(kind))
        if wants("file_path", "category", "content"):
            if self.files is not None:
                view = view.join(self.files.select("file_id", F.col("path").alias("file_path"), F.col("category").alias("category")), "file_id", "left")
            for name in ("file_path", "category"):
                if name not in view.columns:
                    view = view.withColumn(name, F.lit(None).cast("string"))
        if wants(*FLAGS, "visibility", "decorators"):
            if self.function_meta is not None:
                meta = self.function_meta.select(F.col("node_id").alias("id"), *FLAGS, "visibility", F.transform("decorators", lambda d: F.regexp_replace(d, "^@", "")).alias("decorators"))
                view = view.join(meta, "id", "left")
            for name in FLAGS:
                view = view.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in view.columns else F.lit(False))
            view = view.withColumn("visibility", F.coalesce("visibility", F.lit(0)) if "visibility" in view.columns else F.lit(0))
            none = F.array().cast("array<string>")
            view = view.withColumn("decorators", F.coalesce("decorators", none) if "decorators" in view.columns else none)
        if needs and "content" in needs:
            view = view.join(self.side("sources").select("file_id", F.col("text").alias("_source")), "file_id", "left").withColumn("content", content()).drop("_source")
        return view


def content() -> F.Column:
    """The piece of ``_source`` between the start and the end of a span; columns count bytes, and a span outside gives nothing."""
    lines = F.split("_source", "\n")
    taken = F.slice(lines, F.col("start_row") + 1, F.col("end_row") - F.col("start_row") + 1)
    raw = F.encode(F.array_join(taken, "\n"), "UTF-8")
    tail = F.octet_length(F.try_element_at(taken, F.lit(-1))) - F.col("end_col")
    size = F.octet_length(raw) - tail - F.col("start_col")
    inside = (F.col("end_row") >= F.col("start_row")) & (F.col("end_row") < F.size(lines)) & (tail >= 0) & (size > 0)
    return F.coalesce(F.when(inside, F.decode(F.substring(raw, F.col("start_col") + 1, size), "UTF-8")), F.lit(""))
