"""Nearest neighbours by a block matrix join with int8 product tiles.

Candidates and queries are packed into tiles (rows of bytes) and dealt over a grid of cells; each cell multiplies
its queries with its candidates. Unit vectors are quantised to int8, and their exact product with the norms of
what rounding left gives a lower and an upper bound of each cosine. Pairs whose upper bound reaches the k-th
largest lower bound are recomputed in double precision on the original vectors; heaps merge the cells' results.
The result is exact.

Defined cases: rows whose vec_id or vector is null, whose vector is zero, empty, or holds null or non-finite
components take no part; only vectors of one length are compared; a row with the query's own vec_id is never its
neighbour; repeated rows count once; ties go to the smaller vec_id; without other rows a query has no result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import partitions_for

#: Rows of a packed tile, and bytes and rows of vectors that a cell of the grid holds of either side, on average.
TILE = 512
CELL_BYTES = 16 << 20
CELL_ROWS = 1 << 16
#: Products that are worked out at a time within a cell, and components of pairs that are recomputed at a time.
PRODUCTS = 1 << 22
COMPONENTS = 1 << 22
_SLACK = 1e-9
_TILES = "dim long, n long, ids binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out(dim: int) -> pa.RecordBatch:
        ids, rows = zip(*held.pop(dim), strict=True)
        x = np.array(rows)
        small = x.astype(np.float32)
        x = small if (small == x).all() else x
        return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(ids)]), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "n", "ids", "vectors"])

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            held.setdefault(len(v), []).append((i, v))
            if len(held[len(v)]) == TILE:
                yield out(len(v))
    for dim in list(held):
        yield out(dim)


def _unpack(tiles: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids, rows = [], []
    for n, i, v in zip(tiles["n"], tiles["ids"], tiles["vectors"], strict=True):
        ids.append(np.frombuffer(i, dtype=np.int64))
        rows.append(np.frombuffer(v, dtype=np.float32 if len(v) == 4 * n * (len(v) // 4 // n) and len(v) // n == 4 * tiles["dim"].iat[0] else np.float64).reshape(n, -1).astype(np.float64))
    return np.concatenate(ids), np.concatenate(rows)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, the norms of what they stand for, and of what they leave."""
    big = np.abs(x).max(axis=1, keepdims=True)
    unit = x / big  # first to a largest component of 1, so that squares neither overflow nor vanish
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.sqrt((stands * stands).sum(axis=1)), np.sqrt(((unit - stands) ** 2).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(out) | (np.abs(out) > 1.001)
    if odd.any():  # squares beyond the range of doubles
        x, y = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (a, b))
        out[odd] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, cosine) of each query's k nearest of the rows, and maybe some more; a part at a time."""
    codes, scale, norm, rest = quantised(rows)
    kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of codes stay exact
    right = codes.T.astype(kind)
    strip, piece = max(1, PRODUCTS // len(ids)), max(1, COMPONENTS // rows.shape[1])
    for at in range(0, len(queries), strip):
        q = queries[at : at + strip]
        q_codes, q_scale, q_norm, q_rest = quantised(q)
        near = (q_codes.astype(kind) @ right).astype(np.float64) * q_scale[:, None] * scale[None, :]
        error = q_rest[:, None] + q_norm[:, None] * rest[None, :] + _SLACK
        own = query_ids[at : at + strip, None] == ids[None, :]
        low = np.where(own, -np.inf, near - error)
        if len(ids) > k:  # copies of one row may stand at several places, so bounds are taken over distinct ids
            bound = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            bound = np.full(len(q), -np.inf)
        i, j = np.nonzero((near + error >= bound[:, None]) & ~own)
        for a in range(0, len(i), piece):  # copies of one vector may all survive
            b = i[a : a + piece], j[a : a + piece]
            yield query_ids[at + b[0]], ids[b[1]], cosines(q[b[0]], rows[b[1]])


def distinct_rows(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the first of all rows that are alike in id and vector, bit by bit."""
    both = np.concatenate((np.ascontiguousarray(ids, np.int64).view(np.uint8).reshape(len(ids), -1), np.ascontiguousarray(rows).view(np.uint8).reshape(len(ids), -1)), axis=1)
    return np.sort(np.unique(both.view(f"V{both.shape[1]}").ravel(), return_index=True)[1])


def top(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best ids, each with its greatest score; ties go to the smaller id."""
    order = np.lexsort((-s, i, q))
    q, i, s = q[order], i[order], s[order]
    once = np.concatenate(([True], (q[1:] != q[:-1]) | (i[1:] != i[:-1]))) if len(q) else np.zeros(0, bool)
    q, i, s = q[once], i[once], s[once]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], i[rank < k], s[rank < k]


def _first(found: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The k best (-cosine, id)."""
    return heapq.nsmallest(k, found)


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for dim in set(left["dim"]) & set(right["dim"]):
            ids, rows = _unpack(right[right["dim"] == dim])
            if len(np.unique(ids)) < len(ids):
                once = distinct_rows(ids, rows)
                ids, rows = ids[once], rows[once]
            for part in nearest(*_unpack(left[left["dim"] == dim]), ids, rows, k + len(ids) - len(np.unique(ids))):
                best = top(*(np.concatenate(x) for x in zip(best, part, strict=True)), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best, strict=True)))

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True))
        for q, group in groupby(rows, key=lambda r: r[0]):
            mine: dict[int, float] = {}
            for _, i, s in group:
                mine[i] = max(s, mine.get(i, -2.0))
            top = _first([(-s, i) for i, s in mine.items()], k)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(top), pa.int64()), pa.array(range(1, len(top) + 1), pa.int32()), pa.array([i for _, i in top], pa.int64()), pa.array([-s for s, _ in top], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of ``vectors`` to each row of ``queries``."""
    rows, asked = usable(vectors), usable(queries)
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v") * 4), F.lit(0)).alias("b")).first()
    right, left = size(rows), size(asked)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(-(-right["b"] // CELL_BYTES), -(-right["n"] // CELL_ROWS), min(tasks, -(-right["n"] // TILE)), 1)
    down = max(-(-left["b"] // CELL_BYTES), -(-left["n"] // CELL_ROWS), 1)
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    tiles = rows.mapInArrow(_pack, _TILES).withColumn("x", place(across)).withColumn("y", each(down))
    blocks = asked.mapInArrow(_pack, _TILES).withColumn("y", place(down)).withColumn("x", each(across))
    found = blocks.groupBy("x", "y").cogroup(tiles.groupBy("x", "y")).applyInPandas(_cell(k), "query_id long, vec_id long, score double")
    return found.repartition(partitions_for(vectors.sparkSession, 24 * k * left["n"] * across), "query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The query set: rows whose vec_id is divisible by 50."""
    return vectors.where(F.col("vec_id") % 50 == 0)
