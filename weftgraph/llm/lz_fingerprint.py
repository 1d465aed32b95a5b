"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an incremental (LZ78) dictionary. The phrases are segments of the
text, so a prefix sum of weighted code points gives all their hashes in a few numpy calls. The
fingerprint is the ``SIZE`` smallest distinct hashes; two fingerprints are compared by the usual
bottom-k estimate of the Jaccard likeness of the phrase sets, which follows how well one text's
dictionary compresses the other.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, whose likeness is 1
to itself and 0 to others; equal texts have equal fingerprints; with fewer than ``SIZE`` phrases the
likeness is exact. Rows with a null doc_id come last in the order of documents, repeated doc_ids are
ordered by text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import shuffle_partitions

#: Hashes kept of each text; each takes eight hexadecimal digits.
SIZE = 128
#: Runs at most, so that their bounds and heads stay small for the driver; larger tables have longer runs, which are sorted on disk.
RUNS = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def extend(text: str, start: int, stop: int, seen: set[str], ends: list[int]) -> int:
    """Parse text[start:stop] on from a dictionary; appends the phrases' ends, returns where the open phrase starts.

    The dictionary holds every prefix of its phrases, so the search for the longest known one may begin
    near the length of the phrase before it.
    """
    guess = 1
    add, note = seen.add, ends.append
    while start < stop:
        if start + guess > stop:
            guess = stop - start
        if text[start : start + guess] in seen:
            guess += 1
            while start + guess <= stop and text[start : start + guess] in seen:
                guess += 1
            if start + guess > stop:
                break
        else:
            while guess > 1 and text[start : start + guess - 1] not in seen:
                guess -= 1
        add(text[start : start + guess])
        start += guess
        note(start)
    return start


def hashes(text: str, ends: list[int]) -> np.ndarray:
    """Hashes of consecutive phrases that end at ``ends``, the first one starting at 0."""
    if not ends:
        return np.empty(0, dtype=np.uint64)
    stop = np.array(ends, dtype=np.int64)
    start = np.concatenate(([0], stop[:-1]))
    with np.errstate(over="ignore"):
        codes = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * _power(_BASE, len(codes)), dtype=np.uint64)))
        return _mixed((sums[stop] - sums[start]) * _power(_INVERSE, len(codes))[start])


def signature(phrase_hashes: np.ndarray) -> np.ndarray:
    return np.unique((phrase_hashes >> np.uint64(32)).astype(np.uint32))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == SIZE or len(b) == SIZE:  # beyond the k smallest of the union a full signature says nothing
        union = union[:SIZE]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    """Signature of one text."""
    ends: list[int] = []
    extend(text := text or "", 0, len(text), set(), ends)
    return signature(hashes(text, ends))


class _Parsed:
    """A text with its signature, and what is needed to go on from its first half with another text."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.keep = n - n // 2
        self.seen: set[str] = set()
        self.ends: list[int] = []
        self.open = extend(text, 0, self.keep, self.seen, self.ends)
        full, ends = self.seen.copy(), self.ends.copy()
        extend(text, self.open, n, full, ends)
        self.sig = signature(hashes(text, ends))

    def edited(self, other: str) -> str:
        return self.text[: self.keep] + other[: len(self.text) // 2]

    def edited_signature(self, edited: str) -> np.ndarray:
        """May be called once: it goes on in the dictionary of the first half."""
        extend(edited, self.open, len(edited), self.seen, self.ends)
        return signature(hashes(edited, self.ends))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, a: _Parsed, b: _Parsed) -> tuple:
    text = a.edited(b.text)
    sig = a.edited_signature(text)
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(a.text), sha, as_text(a.sig), as_text(sig), likeness(a.sig, sig), likeness(a.sig, b.sig)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    last: tuple | None = None
    for batch in batches:
        rows = []
        for doc_id, text, bucket, border in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "border")), strict=True):
            if last is None and border:
                continue
            here = _Parsed(text)
            if last is not None:
                rows.append(_row(last[0], last[1], here))
            last = None if border else (doc_id, here, bucket)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def _numbers(values: list[int | None]) -> F.Column:
    """An array as one literal, whatever its length; "-" stands for null."""
    return F.transform(F.split(F.lit(",".join("-" if v is None else str(v) for v in values)), ","), lambda v: v.try_cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, border): each bucket is a run of the descending order, ended by the head of the next run.

    The only shuffle of texts. Bounds of the runs are quantiles of doc_id; their heads are as many as the runs.
    """
    n = min(shuffle_partitions(docs), RUNS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts), reverse=True)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))] or [1]
    at = F.lit(0)
    if bounds:  # a binary search: how many bounds lie above
        array = _numbers(bounds)
        at = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda got, step: F.when((got + step <= len(bounds)) & (F.coalesce(F.get(array, got + step - 1), F.lit(0)) > F.col("doc_id")), got + step).otherwise(got),
        )
        at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(at)
    at = at.cast("int")
    heads = {r["bucket"]: r["head"] for r in ids.select("doc_id", at.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # one row a run
    order = sorted(heads)
    target = {b: order[k - 1] for k, b in enumerate(order)}
    # The head of a run also ends the run before it: its target by the run's number, the largest id that a run of null ids has being none.
    every = range(len(bounds) + 1)
    head = F.get(_numbers([heads.get(b) for b in every]), at)
    extra = F.when(F.col("doc_id").eqNullSafe(head), F.array(F.get(_numbers([target.get(b, 0) for b in every]), at).cast("int"))).otherwise(F.array().cast("array<int>"))
    own = at
    rows = docs.select("doc_id", "text", F.posexplode(F.concat(F.array(own), extra)).alias("border", "bucket"))
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket"))
    return rows.sortWithinPartitions("bucket", "border", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, in which the second half gives way to the start of the next document."""
    return with_next(docs).mapInArrow(_walk, SCHEMA)
