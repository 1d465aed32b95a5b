"""What source files fetch, which keys of a response they read, and which keys handlers answer with.

Fetched addresses and read keys are column expressions over whole texts. Answers need nested brackets, so they are read
by a tokeniser on Arrow batches, a file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How calls of the known clients look, how responses are taken apart, and names of a response that are no keys of it.
_URL = r"""\s*\(\s*['"`]([^'"`$\s]+)['"`]"""
FETCH = r"\bfetch" + _URL
FETCH_METHOD = FETCH + r"""\s*,\s*\{[^}]*["']?method["']?\s*:\s*['"]([A-Za-z]+)['"]"""
AXIOS = r"\baxios\s*\.\s*(get|post|put|delete|patch)" + _URL
JQUERY = r"\$\s*\.\s*(get|post)" + _URL
PYTHON_CLIENTS = r"\b(?:requests|httpx)\s*\.\s*(get|post|put|delete|patch|head|options)" + _URL
JSON_PARTS = r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:await\s+)?(?:\w+\.json\s*\(\)|(?:await\s+)?(?:fetch|axios|got)\s*\([^)]*\)(?:\.then\s*\([^)]*\))?(?:\.json\s*\(\))?)"
DATA_PARTS = r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:data|result|response|json|body|res)\b"
DATA_KEY = r"\b(?:data|response|result|json|body|res)\s*(?:\?\.|\.)(\w+)"
PART = r"(\w+)\s*(?::\s*\w+)?"
NO_KEYS = (
    "json text blob arrayBuffer formData ok status headers clone then catch finally "
    "map filter forEach reduce find some every push pop shift unshift splice slice concat join sort reverse includes indexOf "
    "length toString valueOf keys values entries "
    "appendChild removeChild insertBefore replaceChild replaceChildren createElement getElementById querySelector querySelectorAll "
    "setAttribute getAttribute removeAttribute hasAttribute addEventListener removeEventListener dispatchEvent classList className "
    "parentNode parentElement childNodes children nextSibling previousSibling firstChild lastChild click focus blur submit reset "
    "innerHTML outerHTML textContent innerText"
).split()
STATUS_BEFORE = re.compile(r"\.status\s*\(\s*(\d{3})\s*\)\s*$")
STATUS_AFTER = re.compile(r"\s*,\s*\{[^}]*status\s*:\s*(\d{3})")
PHP_KEY = re.compile(r"""['"]([a-zA-Z_][a-zA-Z0-9_]*)['"]\s*=>""")
PHP_END = re.compile(r"\b(?:exit|die)\s*(?:\([^)]*\))?\s*;")
PHP_STATUS = [re.compile(p) for p in (r"http_response_code\s*\(\s*(\d{3})\s*\)", r"""header\s*\(\s*['"]HTTP/[\d.]+\s+(\d{3})""", r"""header\s*\(\s*['"]Status:\s*(\d{3})""")]

_SCRIPT_TOKEN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|([{}])|([A-Za-z_$][A-Za-z0-9_$]*)|[^"'`{}A-Za-z_$]+|.""", re.S)
_PHP_TOKEN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([\[({])|([\])}])|[^"'\[\](){}]+|.""", re.S)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def fetched(text: Column) -> Column:
    """Distinct (method, url) that a text fetches; a plain fetch is a GET unless its address is fetched with a method elsewhere."""
    calls = lambda methods, urls: F.arrays_zip(methods, urls).cast("array<struct<method:string,url:string>>")
    upper = lambda a: F.transform(a, lambda m: F.upper(m))
    given = _all(text, FETCH_METHOD, 1)
    plain = F.array_except(_all(text, FETCH, 1), given)
    parts = [calls(upper(_all(text, FETCH_METHOD, 2)), given), calls(F.transform(plain, lambda u: F.lit("GET")), plain)]
    parts += [calls(upper(_all(text, p, 1)), _all(text, p, 2)) for p in (AXIOS, JQUERY, PYTHON_CLIENTS)]
    return F.array_distinct(F.concat(*parts))


def read_keys(text: Column) -> Column:
    """Sorted names of the keys that a text reads from responses: taken apart from one, or after a dot."""
    parts = F.concat(_all(text, JSON_PARTS, 1), _all(text, DATA_PARTS, 1))
    taken = F.flatten(F.transform(parts, lambda b: _all(b, PART, 1)))
    return F.array_sort(F.array_distinct(F.concat(taken, F.array_except(_all(text, DATA_KEY, 1), F.array(*map(F.lit, NO_KEYS))))))


def consumers(files: DataFrame) -> DataFrame:
    """(file_id, method, url, keys): each fetch of a file (file_id, text) with all keys that the file reads."""
    found = files.select("file_id", F.explode(fetched(F.col("text"))).alias("f"), read_keys(F.col("text")).alias("keys"))
    return found.select("file_id", "f.method", "f.url", "keys")


def _script_keys(text: str, at: int) -> tuple[list[str], int]:
    """The names at the top of the braces that open at ``at``, and where these end (-1: nowhere)."""
    keys, depth = [], 0
    for t in _SCRIPT_TOKEN.finditer(text, at):
        quoted, brace, word = t.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            if depth == 0:
                return keys, t.start()
        elif depth == 1 and (quoted or word):
            after = re.compile(r"\s*(.?)", re.S).match(text, t.end()).group(1)
            if after == ":" or (word and after and after in ",}"):
                keys.append(quoted[1:-1] if quoted else word)
    return keys, -1


def script_shape(text: str) -> tuple[set[str], set[str]]:
    """Keys of answers and of errors, from the calls of ``.json`` with an object; a status of 400 or more makes an error."""
    good, bad = set(), set()
    for call in re.finditer(r"\.json\s*\([^{)]*\{", text):
        keys, end = _script_keys(text, call.end() - 1)
        found = STATUS_BEFORE.search(text[max(0, call.start() - 200) : call.start()]) or (STATUS_AFTER.match(text[end + 1 : end + 151]) if end > 0 else None)
        (bad if found and int(found.group(1)) >= 400 else good).update(keys)
    return good, bad


def _php_keys(text: str, at: int) -> set[str] | None:
    """The keys at the top of the bracket that opens at ``at``; none if it never closes."""
    depth, top = 0, []
    for t in _PHP_TOKEN.finditer(text, at):
        _, opens, closes = t.groups()
        depth -= bool(closes)
        if closes and depth == 0:
            return {k for piece in "".join(top).split("\0") for k in PHP_KEY.findall(piece)}
        if depth == 1:
            # What a nested bracket holds leaves a mark, so that nothing matches across it.
            top.append("\0" if opens or closes else t.group())
        depth += bool(opens)
    return None


def php_shape(text: str) -> tuple[set[str], set[str]]:
    """As ``script_shape``, from ``json_encode`` of an array; the last status set before it counts, after the last exit."""
    good, bad = set(), set()
    for call in re.finditer(r"json_encode\s*\(\s*(?:array(?=\()|(?=\[))", text):
        keys = _php_keys(text, call.end())
        if keys:
            before = PHP_END.split(text[max(0, call.start() - 300) : call.start()])[-1]
            status = next((int(hits[-1]) for p in PHP_STATUS if (hits := p.findall(before))), 0)
            (bad if status >= 400 else good).update(keys)
    return good, bad


SHAPES = {"javascript": script_shape, "typescript": script_shape, "php": php_shape}


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [SHAPES[x](t) for x, t in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        each = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.string())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), *each], ["file_id", "response_keys", "error_keys"])


def answers(files: DataFrame) -> DataFrame:
    """(file_id, response_keys, error_keys) of the files (file_id, language, text) that answer with any key."""
    rows = files.where(F.col("language").isin(*SHAPES) & F.col("text").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "language", "text")
    out = rows.mapInArrow(_shaped, "file_id long, response_keys array<string>, error_keys array<string>")
    return out.where((F.size("response_keys") > 0) | (F.size("error_keys") > 0))
