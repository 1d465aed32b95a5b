"""Near copies by the Jaccard coefficient of their sets of five-word shingles.

This is the near-duplicate stage of the pipeline, by the method of ``simhash_dedup`` on sets of shingles: each distinct
set has a SimHash fingerprint, deletion variants of its halves index it, an equality join and verification find all
fingerprints within two bits, and contraction makes components. The fingerprints' links are candidates here, and an
exact check follows: sets in one group of candidates are compared in full, and those with a coefficient of ``LEAST``
or more are linked.

Fingerprints of 64 bits cannot carry a coefficient of 0.8 alone: such pairs differ in some ten bits, and segments short
enough to differ in one bit at most are shared by chance. So candidates beyond two bits are added by minimum hashes:
each set has 288 of them in 48 bands of six. All sets of a band are joined to its smallest one, a star, so that a
crowded band costs as many edges as it has sets; the components of the stars and the fingerprints' links are groups. A
pair at just 0.8 shares no band with a chance of about one in two million, and less above.

A large group is cut into blocks by size of set and by hash; every two blocks whose sizes allow a link meet in a cell
of their own, so no task holds more than two blocks. A cell gives the links of a spanning forest, at most one for each
of its rows; every link of the group lies within one cell's forest.

Defined cases: a null text counts as empty, and texts without words are one class; a text of fewer than five words
is one shingle; case and the kind of white space do not count, so equal sets are one class and never meet in pairs.
Repeated rows are one row of the result, and a null doc_id comes after all others. Extra columns stay, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import simhash_dedup
from weftgraph.llm.common import NO_ID, discard, partitions_for, written
from weftgraph.llm.components import components
from weftgraph.llm.simhash_dedup import keep_rows, majority

WORDS = 5
#: Least Jaccard coefficient of a link.
LEAST = 0.8
BANDS, ROWS = 48, 6
SEED = 42
#: Sets and shingles of a block, on average.
BLOCK_ROWS, BLOCK_HASHES = 256, 1 << 17
_CHUNK, _PART = 512, 1 << 16
_drawn = np.random.default_rng(SEED)
_FACTORS, _TERMS = _drawn.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1), _drawn.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w, join, digest = text.lower().split(), b" ".join, xxhash.xxh64_intdigest
    if not w:
        return np.empty(0, np.uint64)
    parts = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    return np.unique(np.fromiter((digest(join(x), SEED) for x in parts), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the minimum hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK, None] * _FACTORS + _TERMS).min(0), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.tobytes(), SEED + k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles; zero for the empty set."""
    return majority((hashes[at : at + _PART] for at in range(0, len(hashes), _PART)), len(hashes))


def _signed(found: list[int]) -> pa.Array:
    return pa.array(np.array(found, np.uint64).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, prints, keys = [], [], [], []
        for t in batch.column("text").cast(pa.binary()).to_pylist():
            s = shingles(t or b"")
            ids.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            sizes.append(len(s))
            prints.append(fingerprint(s))
            keys.append(bands(s).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), _signed(ids), pa.array(sizes, pa.int32()), _signed(prints), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "id", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t or b"").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], [*names, "s"])


def forest(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links of a cell join: of all its rows, or of its two sides if it has both."""
    n, size = len(sets), np.array(list(map(len, sets)))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(code))))
    two, root, out = bool(side.any() and not side.all()), np.arange(n), []
    for x in range(n):
        if two and side[x]:
            continue
        mine = code[first[x] : first[x + 1]]
        lengths = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=n)
        near = common >= LEAST * (size + size[x] - common) - 1e-9
        for y in np.flatnonzero(near & (root != root[x]) & (side if two else np.arange(n) > x)).tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of each run of equal (root, cell); a run may go on in the next batch."""
    at: tuple | None = None
    held: list[tuple[int, bytes, bool]] = []

    def out() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            ids, sets, side = zip(*held, strict=True)
            found = forest([np.frombuffer(s, np.uint64) for s in sets], np.array(side, bool))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        held.clear()

    for batch in batches:
        for root, cell, side, i, s in zip(*(batch.column(c).to_pylist() for c in ("root", "cell", "side", "id", "s")), strict=True):
            if at != (root, cell):
                yield from out()
                at = (root, cell)
            held.append((i, s, side))
    yield from out()


def fingerprint_edges(first: DataFrame) -> DataFrame:
    """(a, b) of sets in ``first`` (id, n, fp) that join all whose fingerprints differ in at most two bits.

    Sets of one fingerprint are joined to the smallest, and of two linked fingerprints the smallest sets.
    """
    sets = first.where("n > 0").select("id", "fp")
    prints = written(sets.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")), "prints")
    of = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("least").alias(name))
    pairs = simhash_dedup.links(prints.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = sets.join(prints.where("m > 1"), "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = written(pairs.union(same), "near")
    discard(prints)
    return found


def groups(first: DataFrame) -> DataFrame:
    """(id, root) of the sets in ``first`` (id, n, fp, bands) that are candidates with another: components of the fingerprints' links and of the bands' stars."""
    near = fingerprint_edges(first)
    keys = first.select(F.explode("bands").alias("key"), "id")
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "least")
    stars = keys.join(least, "key").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return components(stars.union(near).distinct()).withColumnRenamed("node", "id")


def cells(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (root, id, n, ...) once for each cell that they meet others in, with ``cell`` and ``side``.

    Sets in classes that are not neighbours differ too much in size for a link. A group that fits into a block is one class.
    """
    whole = members.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    small = (F.col("rows") <= BLOCK_ROWS) & (F.col("hashes") <= BLOCK_HASHES)
    # The base is a trifle over 1 / LEAST, so sizes at just that ratio are in neighbouring classes however logarithms round.
    kind = F.when(small, 0).otherwise(F.floor(F.log("n") / F.lit(math.log(1 / LEAST) * (1 + 1e-6)))).cast("long")
    rows = members.join(whole.withColumn("small", small).select("root", "small", "rows", "hashes"), "root").withColumn("kind", kind).drop("rows", "hashes", "small")
    of_kind = rows.groupBy("root", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    n_blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("hashes") / BLOCK_HASHES), F.lit(1)).cast("long")
    of_kind = of_kind.select("root", "kind", n_blocks.alias("blocks"))
    # A group has as many rows here as it has classes of size, a hundred at most.
    by = Window.partitionBy("root").orderBy("kind")
    beside = lambda f, step: F.when(f("kind").over(by) == F.col("kind") + step, f("blocks").over(by)).otherwise(0)
    of_kind = of_kind.select("*", beside(F.lead, 1).alias("over"), beside(F.lag, -1).alias("under"))
    rows = rows.join(of_kind, ["root", "kind"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    place = F.expr("""flatten(array(
        transform(sequence(0L, blocks - 1), j -> struct(kind AS k, 0L AS between, least(block, j) AS i, greatest(block, j) AS j, block > j AS side)),
        transform(if(over > 0, sequence(0L, over - 1), array()), j -> struct(kind AS k, 1L AS between, block AS i, j AS j, false AS side)),
        transform(if(under > 0, sequence(0L, under - 1), array()), i -> struct(kind - 1 AS k, 1L AS between, i AS i, block AS j, true AS side))))""")
    rows = rows.select(*members.columns, F.explode(place).alias("place"))
    cell = F.concat_ws(".", "place.k", "place.between", "place.i", "place.j")
    return rows.select(*members.columns, cell.alias("cell"), F.col("place.side").alias("side"))


def links(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct sets in ``first`` (id, first, n, fp, bands) with a coefficient of ``LEAST`` or more.

    They join what all such pairs join; pairs of sets that others join already may be left out.
    """
    found = written(groups(first), "groups")
    members = first.join(found, "id").select("root", "id", "n", F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    members = written(members, "members")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kept_id"), F.xxhash64("text").alias("kept_key"), "text")
    needed = texts.join(members.select("kept_id", "kept_key", "id"), ["kept_id", "kept_key"]).select("id", "text")
    sets = needed.mapInArrow(_sets, "id long, s binary").dropDuplicates(["id"])
    placed = written(cells(members.select("root", "id", "n")), "cells")
    size = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    dealt = placed.join(sets, "id").repartition(partitions_for(docs.sparkSession, 8 * size["n"] + 64 * size["rows"]), "root", "cell")
    out = written(dealt.sortWithinPartitions("root", "cell").select("root", "cell", "side", "id", "s").mapInArrow(_linked, "a long, b long"), "links")
    discard(found, members, placed)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """(id, first, n, fp, bands): of each distinct set its first row, size, fingerprint and bands, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    described = rows.mapInArrow(_described, "doc_id long, text_key long, id long, n int, fp long, bands array<long>")
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("text_key").alias("text_key"))
    return written(described.groupBy("id").agg(F.min(row).alias("first"), *(F.first(c).alias(c) for c in ("n", "fp", "bands"))), "classes")


def near_copies(docs: DataFrame) -> DataFrame:
    """(id, first, root): of each distinct set its first row and the root of its group of linked sets."""
    first = classes(docs)
    roots = components(links(docs, first)).withColumnRenamed("node", "id")
    return first.select("id", "first").join(roots, "id", "left").select("id", "first", F.coalesce("root", "id").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group of linked texts, one row each."""
    return keep_rows(docs, near_copies(docs).groupBy("root").agg(F.min("first").alias("first")))
