"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that differ in at most two bits, one half
differs in at most one, so both share a variant of that half with one bit deleted. Each distinct fingerprint is
indexed under its 64 variants; an equality join on them gives candidates, which are verified in full.

A variant that more than ``CROWD`` distinct fingerprints share is not paired up. Its members are indexed again
under their 2016 variants with two bits deleted from the whole; at most four distinct fingerprints share one of
these, so the links stay exact and the work linear.

Defined cases: a null text counts as empty, and texts without words have fingerprint zero, linked like any other;
rows with equal fingerprints are one class, so copies never meet in pairs; repeated rows stay rows of the result;
a null doc_id is no component id unless the component has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import NO_ID, fresh, n_rows, partitions_for, row_key, written
from weftgraph.llm.components import components

SEED = 42
WORDS = 3
#: Most differing bits of a link.
BITS = 2
#: Distinct fingerprints under one variant beyond which two-bit variants take over.
CROWD = 128
_CHUNK = 1 << 16


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """Bits that are set in over half of ``n`` hashes, which come in parts, as an unsigned number."""
    total = np.zeros(64, dtype=np.int64)
    for h in parts:
        total += np.unpackbits(h.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in over half the shingle hashes, as an unsigned number."""
    w = text.lower().split()
    if not w:
        return 0
    n, digest, join = max(1, len(w) - words + 1), xxhash.xxh64_intdigest, b" ".join

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, n, _CHUNK):
            part = w[at : at + _CHUNK + words - 1]
            shingles = zip(*(part[k:] for k in range(words)), strict=False) if len(part) >= words else [part]
            yield np.array([digest(join(x), SEED) for x in shingles], dtype=">u8")

    return majority(hashes(), n)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found)], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every row, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return written(rows.mapInArrow(_fingerprints(words), "doc_id long, text_key long, fp long"), "fingerprints")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links within runs of equal keys; members of crowded runs come out as links to themselves."""
    held_key, held_fp, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(key):
            continue
        key, fp = np.concatenate((held_key, key)), np.concatenate((held_fp, fp))
        edge = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate(([0], edge))
        size = np.diff(np.concatenate((start, [len(key)])))
        crowd = (size > CROWD) | (key[start] == crowded if crowded is not None else False)
        hot = np.repeat(crowd, size)
        last = start[-1]
        hot_fp = fp[hot]
        if crowd[-1]:
            crowded, held_key, held_fp, stop = key[-1], np.empty(0, np.int64), np.empty(0, np.int64), len(key)
        else:  # the run may go on in the next batch
            crowded, held_key, held_fp, stop = None, key[last:], fp[last:], last
        yield _links(key[:stop], fp[:stop], hot[:stop], hot_fp)
    yield _links(held_key, held_fp, np.zeros(len(held_key), bool), held_fp[:0])


def _links(key: np.ndarray, fp: np.ndarray, hot: np.ndarray, hot_fp: np.ndarray) -> pa.RecordBatch:
    at, k, found = np.flatnonzero(~hot), 1, [(hot_fp, hot_fp)]
    while len(at):
        at = at[at + k < len(key)]
        at = at[key[at] == key[at + k]]
        a, b = fp[at], fp[at + k]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= BITS
        found.append((np.minimum(a, b)[near], np.maximum(a, b)[near]))
        k += 1
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], ["a", "b"])


def _bucketed(keys: DataFrame, rows: int) -> DataFrame:
    """Links among the ``rows`` rows (key, fp) that share a key."""
    return keys.repartition(partitions_for(keys.sparkSession, 24 * rows), "key").sortWithinPartitions("key", "fp").mapInArrow(_pairs, "a long, b long")


def _one_bit_variants(fps: DataFrame) -> DataFrame:
    """Both halves with each of their bits deleted; the number of half and bit makes variants of different bits differ."""
    bit = F.col("bit").cast("int")
    half = F.when(bit < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    mask = F.expr("~shiftleft(1L, bit % 32)")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select((F.shiftleft(bit.cast("long"), 32).bitwiseOR(half.bitwiseAND(mask))).alias("key"), "fp")


def _two_bit_variants(fps: DataFrame) -> DataFrame:
    """The whole with each two bits deleted. Hashes are the keys; verification makes chance meetings harmless."""
    bits = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i AS i, j AS j))))")
    each = fps.select("fp", F.explode(bits).alias("d"))
    return each.select(F.expr("xxhash64(d.i, d.j, fp & ~(shiftleft(1L, d.i) | shiftleft(1L, d.j)))").alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of the distinct ``fps`` that differ in at most two bits."""
    found = written(_bucketed(_one_bit_variants(fps), 64 * n_rows(fps)), "links")
    plain = found.where("a <> b")
    crowd = written(found.where("a = b").select(F.col("a").alias("fp")).distinct(), "crowd")
    if size := n_rows(crowd):
        plain = plain.union(_bucketed(_two_bit_variants(crowd), 2016 * size).where("a <> b"))
    return plain.distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, doc_id, text_key): of each distinct fingerprint its component's root and its own first row."""
    first = prints.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("text_key").alias("text_key"))).alias("first"))
    first = written(first, "classes")
    roots = components(links(first.select("fp")))
    return first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = fingerprints(docs, words)
    known = written(classes(prints), "members")
    smallest = known.groupBy("root").agg(F.min("first.doc_id").alias("least"))
    component = known.select("fp", "root").join(smallest, "root").select("fp", F.nullif(F.col("least"), F.lit(NO_ID)).alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(component, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, one row each."""
    return keep_rows(docs, written(classes(fingerprints(docs, words)), "members").groupBy("root").agg(F.min("first").alias("first")))


def keep_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first`` names by doc_id and text_key, one row each."""
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    own_id, own_key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"])
    found = docs.join(kept, (own_id == kept["kept_id"]) & (own_key == kept["kept_key"]), "left_semi")
    # Repeated rows share both keys; the one with the least hash of all columns stays.
    names = [fresh(docs, n) for n in ("kept_id", "kept_key", "kept_row")]
    by = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(names[0]), F.xxhash64("text").alias(names[1])]
    return found.groupBy(*by).agg(F.min_by(F.struct(*found.columns), row_key(found)).alias(names[2])).select(f"{names[2]}.*")
