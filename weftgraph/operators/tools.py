"""Uses of outside tools: what files import from known packages, and the lines that call it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import file_category

# Packages by category, and names that scripts have without an import.
PACKAGES = {
    "http": "axios got ky node-fetch undici requests httpx aiohttp urllib3 urllib.request net/http reqwest hyper ureq".split(),
    "db": "pg mysql mysql2 psycopg psycopg2 sqlalchemy sqlx mongoose prisma drizzle-orm typeorm sequelize mongodb pymongo".split(),
    "redis": "redis ioredis redis-py".split(),
    "queue": "celery bull bullmq amqplib kafkajs aiokafka @aws-sdk/client-sqs boto3".split(),
}
SCRIPT_GLOBALS = ["fetch", "XMLHttpRequest"]
FAMILIES = {"js": "ts tsx js jsx mjs cjs".split(), "py": ["py"], "go": ["go"], "rs": ["rs"]}


def _family(path: Column) -> Column:
    names = {e: f for f, ends in FAMILIES.items() for e in ends}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.try_element_at(table, F.element_at(F.split(path, r"\."), -1))


def category(package: Column) -> Column:
    """Category of a package or of a path within one; null for others."""
    table = F.create_map(*(F.lit(x) for c, names in PACKAGES.items() for n in names for x in (n, c)))
    parts = F.split(package, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.get(F.filter(F.transform(prefixes, lambda p: F.try_element_at(table, p)), lambda c: c.isNotNull()), 0)


def _names(listed: Column, alias: str) -> Column:
    """The names that a comma-separated list binds: the alias where one is given."""
    items = F.transform(F.split(listed, ","), lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, ";+$", ""), f"^.*{alias}", "")))
    return F.filter(items, lambda n: n != "")


def _imports(text: Column) -> dict[str, list[tuple[Column, Column]]]:
    """(package, bound names) by language of what a line may import; null or empty where it imports nothing so."""
    line = F.trim(text)
    part = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    from_ = r"^import (.+) from\s+[\"']([^\"']*)[\"']\s*;*$"
    spec, braces = part(from_, 1), r"\{([^}]*)\}"
    plain = F.trim(F.regexp_replace(F.regexp_replace(spec, braces, ""), r"[\s,]+$", ""))
    whole = F.regexp_extract(spec, r"^\s*\* as (.+)$", 1)
    js = F.when(whole != "", F.array(F.trim(whole))).otherwise(F.concat(_names(F.regexp_extract(spec, braces, 1), " as "), F.filter(F.array(plain), lambda n: n != "")))
    require = r"^(?:const |let |var )?([^=]+)=.*require\([\"']([^\"']*)[\"']"
    left = part(require, 1)
    needed = F.when(left.contains("{"), _names(F.regexp_extract(left, braces, 1), ":")).otherwise(F.array(F.trim(left)))
    py_from = r"^from (.+?) import (.+)$"
    go = r"^(?:import\s+)?([A-Za-z_.][A-Za-z0-9_]*)?\s*\"([^\"]+)\"\s*;*$"
    go_name = F.coalesce(part(go, 1), F.element_at(F.split(part(go, 2), "/"), -1))
    use, tail = part(r"^use ([^:;{]+?)(?:::.*)?;*$", 1), part(r"^use [^:;{]+?::(.*?);*$", 1)
    used = F.when(tail.isNull(), F.array(use)).when(tail.contains("{"), _names(F.regexp_extract(tail, braces, 1), "(?: as |::)")).otherwise(F.array(F.trim(F.regexp_replace(tail, "^.*(?: as |::)", ""))))
    return {"js": [(part(from_, 2), js), (part(require, 2), needed)], "py": [(F.trim(part(py_from, 1)), _names(part(py_from, 2), " as "))], "go": [(part(go, 2), F.array(go_name))], "rs": [(use, used)]}


def _typed(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the files that are read: neither tests nor references, and of a known language."""
    read = files.select("file_id", _family(F.col("path")).alias("family"), file_category(F.col("path")).alias("c")).where("family IS NOT NULL AND c NOT IN ('Test', 'Reference')")
    return lines.join(read.select("file_id", "family"), "file_id")


def bindings(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, local, package, category): names that files (file_id, path) bind to known packages on their lines (file_id, line, text).

    A name that is bound twice stands for the last package; ``fetch`` and ``XMLHttpRequest`` are bound in every script.
    """
    typed = _typed(lines, files)
    found = []
    for family, forms in _imports(F.col("text")).items():
        mine = typed.where(F.col("family") == family)
        for package, names in forms:
            found.append(mine.select("file_id", "line", package.alias("package"), names.alias("names")).select("file_id", "line", "package", F.explode("names").alias("local")))
    # ``import a, b as c`` names a package for each item.
    items = F.split(F.regexp_extract(F.trim("text"), r"^import (.+?);*$", 1), ",")
    each = typed.where("family = 'py'").select("file_id", "line", F.explode(items).alias("item")).select("file_id", "line", F.trim(F.regexp_replace("item", " as .*$", "")).alias("package"), F.trim(F.regexp_replace("item", "^.* as ", "")).alias("local"))
    out = each
    for rows in found:
        out = out.unionByName(rows)
    scripts = files.where((_family(F.col("path")) == "js") & ~file_category(F.col("path")).isin("Test", "Reference"))
    given = scripts.select("file_id", F.lit(-1).alias("line"), F.explode(F.array(*map(F.lit, SCRIPT_GLOBALS))).alias("local")).select("file_id", "line", F.col("local").alias("package"), "local")
    known = out.withColumn("category", category(F.col("package"))).where("category IS NOT NULL AND local <> ''").unionByName(given.withColumn("category", F.lit("http")))
    return known.groupBy("file_id", "local").agg(F.max_by(F.struct("package", "category"), F.struct("line", "package")).alias("b")).select("file_id", "local", "b.package", "b.category")


def uses(lines: DataFrame, files: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """(category, package, callee, file_id, line, n): calls of bound names, ``name(`` or ``name.member``, n times on a line.

    Import lines are left out, as are all lines of tests and references. ``categories`` keeps some of the four.
    """
    if wrong := set(categories) - set(PACKAGES):
        raise ValueError(f"unknown categories {sorted(wrong)}; there are {sorted(PACKAGES)}")
    bound = bindings(lines, files)
    bound = bound.where(F.col("category").isin(list(categories))) if categories else bound
    text = F.ltrim("text")
    imports = (
        F.when(F.col("family") == "js", text.startswith("import ") | text.startswith("import{")).when(F.col("family") == "py", text.rlike(r"^(import |from[ \t])"))
        .when(F.col("family") == "go", text.rlike(r"^import[ (]")).otherwise(text.rlike(r"^(use |extern crate)"))
    )
    called = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("local"), F.lit(r"\E(?=(\.[A-Za-z0-9_]+|\())"))
    pairs = _typed(lines, files).where(~imports).join(bound, "file_id").where(F.contains("text", F.col("local")))
    hits = pairs.select("category", "package", "file_id", "line", "local", F.explode(F.regexp_extract_all("text", called, F.lit(1))).alias("tail"))
    callee = F.when(F.col("tail") == "(", F.col("local")).otherwise(F.concat("local", "tail"))
    return hits.groupBy("category", "package", callee.alias("callee"), "file_id", "line").agg(F.count(F.lit(1)).alias("n"))
