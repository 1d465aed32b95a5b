"""Text functions as column expressions: identifier tokens, globs, topics, routes, reasons."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]|[0-9]+"


def identifier_tokens(name: Column) -> Column:
    """The identifier in lower case, followed by its parts where there are several: at case, acronym, digit and other boundaries."""
    parts = F.transform(F.regexp_extract_all(name, F.lit(_PART), F.lit(0)), F.lower)
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lower(name)), parts)).when(F.length(name) > 0, F.array(F.lower(name))).otherwise(F.array().cast("array<string>"))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ``*`` stays within a segment of dots or slashes, ``**`` does not, ``?`` is one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        out.append("[^./]*" if c == "*" else "[^./]" if c == "?" else c if c.isalnum() or c == "_" else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def topic(name: Column) -> Column:
    """Canonical form of a topic: no environment in front, no version behind, slashes for separators and at humps, lower case."""
    t = F.regexp_replace(F.regexp_replace(name, r"^(?:prod|dev|staging)\.", ""), r"\.v[0-9]+$", "")
    t = F.trim(F.replace(F.translate(t, "_-:.", "////"), F.lit("//"), F.lit("/")), F.lit("/"))
    t = F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "/")
    return F.lower(F.replace(t, F.lit("//"), F.lit("/")))


def route_path(path: Column) -> Column:
    """A route's path in one form: no query, no slashes at the ends; segments that are or hold a parameter are ``:*``."""
    plain = F.trim(F.regexp_replace(path, r"(?s)\?.*$", ""), F.lit("/"))
    return F.regexp_replace(plain, r"(^|/)(?::[^/]*|\{[^/]*\}|<[^/]*>|[^/]*\$\{[^/]*)(?=/|$)", "$1:*")


def reason(keys: Column, fetches: Column) -> Column:
    """Code of what a consumer reads: ``fetch-url-match|keys:a,b|fetches:N``."""
    return F.concat(F.lit("fetch-url-match|keys:"), F.array_join(keys, ","), F.lit("|fetches:"), fetches.cast("string"))


def reason_keys(code: Column) -> Column:
    found = F.regexp_extract(code, r"\|keys:([^|]*)", 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, ","))


def reason_fetches(code: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(code, r"\|fetches:(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))


def prefix_likeness(a: Column, b: Column) -> Column:
    """Length of the common start over that of the longer string."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda k: (k > 0) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 0.0).otherwise(same / F.greatest(F.length(a), F.length(b)))


def literal_likeness(a: Column, b: Column) -> Column:
    """Normalised edit likeness, or 0.9 where one of at least four characters sits in the other at a boundary."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = (F.length(short) >= 4) & F.rlike(long, F.concat(F.lit(r"(^|[^A-Za-z0-9])\Q"), short, F.lit(r"\E($|[^A-Za-z0-9])")))
    return F.greatest(edit, F.when(inside, 0.9).otherwise(0.0))


# What marks a path's category: directories, pieces and ends in lower case, and ends of test classes as they are.
REFERENCE_DIRS = "vendor node_modules .venv venv site-packages .tox .bundle gems .pub-cache .gradle .m2 pods carthage .build third_party external deps".split()
EXAMPLE_DIRS = "examples example sample samples demo demos".split()
TEST_PIECES = ".test. .spec. -spec. __tests__/ __mocks__/ /test/ /tests/ /testing/ /fixtures/ /e2e/ /spec/ /test_ /conftest.".split()
TEST_ENDS = "_test.go _test.py _spec.rb _test.rb".split()
TEST_CLASSES = "Test.java Tests.java Test.kt Tests.kt Tests.swift Tests.cs Test.cs Test.php Spec.scala Test.scala".split()
DOCUMENT_ENDS = ".md .txt .rst".split()
CONFIG_ENDS = ".json .toml .yaml .yml dockerfile".split()


def _any(values: list[str], before: str = "", after: str = "") -> str:
    return before + "(" + "|".join(re.escape(v) for v in values) + ")" + after


def file_category(path: Column) -> Column:
    """Reference, example, test, document, config or source, the first that fits."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.concat(F.lit("/"), F.lower(plain))
    test = p.rlike(_any(TEST_PIECES)) | p.rlike(_any(TEST_ENDS, after="$")) | plain.rlike(_any(TEST_CLASSES, after="$"))
    return (
        F.when(p.rlike(_any(REFERENCE_DIRS, "/", "/")), "Reference").when(p.rlike(_any(EXAMPLE_DIRS, "/", "/")), "Example").when(test, "Test")
        .when(p.rlike(_any(DOCUMENT_ENDS, after="$")), "Document").when(p.rlike(_any(CONFIG_ENDS, after="$")), "Config").otherwise("Source")
    )


def language(path: Column) -> Column:
    """Language of a file by its name."""
    # File endings.
    endings = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "sql": "sql", "sh": "bash", "sol": "solidity", "zig": "zig", "lua": "lua", "dart": "dart", "ex": "elixir"}
    table = F.create_map(*(F.lit(x) for kv in endings.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
