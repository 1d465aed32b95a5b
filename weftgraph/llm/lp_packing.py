"""Packing documents into sequences by a configuration linear program.

Texts become token ids, each document ends with an end id, and longer ones are cut into pieces. The lengths of
the pieces form a histogram of at most ``capacity`` entries, the only thing that comes to the driver. A
configuration is a set of lengths that fits into a sequence; the linear program asks for the fewest sequences
whose configurations cover the histogram. Multiplicative weights solve it: each pass prices the lengths by what
is still uncovered, a knapsack dynamic programme tells the worth of all spaces, and of it follows for each length
the best configuration that holds it. Passes go on until all is covered. The solution is rounded down to whole
sequences; the programme is solved again for what that left, now in whole numbers; and best fit by falling length
places the few pieces that fill no sequence any more. Prices also bound the programme's optimum from below, as any
prices do; ``solve`` gives that bound with the plan. Each piece then looks up the place that its rank among the
pieces of its length has in the plan.

Defined cases: a null text counts as empty and is a single end id; empty tables give no rows; repeated rows and
null doc_ids are packed like others; extra columns are ignored. No id is dropped, repeated or split across
sequences other than by the cuts.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import written

CAPACITY = 2048
END = 0
#: Share of what is uncovered of a length that one pass may cover, at first and in whole numbers, and how sharply its price falls as it is covered.
PASS_SHARE, WHOLE_SHARE = 0.5, 0.25
SHARPNESS = 1.0
#: Long pieces are priced above their length to this power, so short ones, which fill gaps, are left for later.
LEAN = 0.5
#: Solutions at most, and how much dearer a length becomes for the next one by the share of it that was left to best fit.
ROUNDS, RISE = 4, 0.5
#: Share of a length that the fractional solution may leave to rounding.
LEFT = 0.05
#: Share of a sequence that a configuration may leave empty; beyond it best fit does better.
WASTE = 0.02

#: Characters on which both tokenizer libraries split alike (tested); texts with others, or with a long unbroken run, take the slower one.
_PLAIN = re.compile("[\t\n\r -~ -ɏ‐-‟…€]*")
_RUN = re.compile(r"\S{5000}|\s{5000}")
_loaded: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, and a faster one with the same ids where the file allows it; once in each process."""
    if path not in _loaded:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        order = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special) if order == list(range(256, 256 + len(order))) else None
        _loaded[path] = Tokenizer.from_file(path), fast
    return _loaded[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text, without the end id."""
    whole, fast = _tokenizer(path)
    if fast is not None and _PLAIN.fullmatch(text) and not (len(text) >= 5000 and _RUN.search(text)):
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
    return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(length: int, capacity: int) -> list[int]:
    """Where pieces start: only the first may be shorter than the capacity."""
    return [0, *range(length % capacity or capacity, length, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"


def _tokenised(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turns = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(END)).astype("<u4")
                starts = cuts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(turns[b - a])))
                    turns[b - a] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def worths(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most that fits into each space up to the capacity (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        k = upto[c]
        value[c] = max(value[c - 1], (prices[:k] + value[c - lengths[:k]]).max()) if k else 0.0
    return value


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Sequences that the programme needs at least.

    Any prices are a feasible dual once no configuration is worth over 1: here the lengths, and one for each length over half.
    """
    if not len(lengths):
        return 0.0
    return max(float((lengths * counts).sum() / worths(lengths, lengths.astype(float), capacity)[capacity]), float(counts[2 * lengths > capacity].sum()))


def completed(first: int, lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, room: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The best configuration that holds the length ``first``, with at most ``room`` copies of each, and the space it leaves."""
    found, space, spare = {first: 1}, capacity - int(lengths[first]), room.copy()
    spare[first] -= 1
    while k := int(np.searchsorted(lengths, space, side="right")):
        worth = np.where(spare[:k] >= 1, prices[:k] + value[space - lengths[:k]], -1.0)
        j = int(worth.argmax())
        if worth[j] < 0:
            break
        found[j] = found.get(j, 0) + 1
        spare[j] -= 1
        space -= int(lengths[j])
    return found, space


def _pass(lengths: np.ndarray, counts: np.ndarray, left: np.ndarray, weights: np.ndarray, capacity: int, waste: int, whole: bool) -> list[tuple[dict[int, int], float]]:
    """Configurations of one pass, from the longest length on, and their uses; ``left`` falls by what they cover."""
    live = np.flatnonzero(left >= 1 if whole else left > LEFT * counts)
    own, share = lengths[live], left[live] / counts[live]
    prices = weights[live] * np.exp(SHARPNESS * (share - share.max()))
    value = worths(own, prices, capacity)
    budget = np.maximum(1, np.floor(WHOLE_SHARE * left[live])) if whole else PASS_SHARE * left[live]
    # Copies in a configuration: of a length that is used less than once in a pass, one.
    room, out = np.maximum(1, np.floor(budget)), []
    for j in range(len(live) - 1, -1, -1):
        if budget[j] < (1 if whole else 1e-9):
            continue
        usable = np.where(budget >= (1 if whole else 1e-9), np.minimum(room, budget) if whole else room, 0)
        found, space = completed(j, own, prices, value, usable, capacity)
        if space > waste:
            continue
        times = min(budget[i] / n for i, n in found.items())
        times = float(int(times)) if whole else times
        out.append(({int(live[i]): n for i, n in found.items()}, times))
        for i, n in found.items():
            budget[i] -= n * times
            left[live[i]] -= n * times
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations of indices and how often each is used; together they cover all but ``LEFT`` of each length, or all that fills sequences."""
    left, used, waste = counts.astype(float), {}, 0
    while (left > LEFT * counts).any():
        found = _pass(lengths, counts, left, weights, capacity, waste, whole=False)
        for pattern, times in found:
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + times
        if not found:  # nothing fills a sequence that well any more
            if (waste := max(1, 2 * waste)) > capacity * WASTE:
                break
    return [(dict(k), x) for k, x in used.items()]


def rounded(solved: list[tuple[dict[int, int], float]], lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole uses of configurations of indices, and what they leave: the solution rounded down, then the programme in whole numbers for the rest."""
    left, out, waste = counts.astype(float), [], 0
    for pattern, times in solved:
        if whole := int(times + 1e-9):
            out.append((pattern, whole))
            for j, n in pattern.items():
                left[j] -= n * whole
    while (left >= 1).any():
        found = _pass(lengths, counts, left, weights, capacity, waste, whole=True)
        out += [(pattern, int(times)) for pattern, times in found]
        if not found and (waste := max(1, 2 * waste)) > capacity * WASTE:
            break
    return out, left.astype(np.int64)


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling length, over groups of equal sequences: (copies by length, number of sequences)."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length, n in sorted(zip(lengths, counts, strict=True), reverse=True):
        for space in sorted(s for s in groups if s >= length):
            if not n:
                break
            fits, keep = space // length, []
            for pattern, times in groups.pop(space):
                full = min(times, n // fits)
                rest = min(n - full * fits, fits - 1) if full < times else 0
                n -= full * fits + rest
                if full:
                    groups.setdefault(space - fits * length, []).append((pattern | {length: fits}, full))
                if rest:
                    groups.setdefault(space - rest * length, []).append((pattern | {length: rest}, 1))
                if times > full + bool(rest):
                    keep.append((pattern, times - full - bool(rest)))
            if keep:
                groups.setdefault(space, []).extend(keep)
        fits = capacity // length
        if n // fits:
            groups.setdefault(capacity - fits * length, []).append(({length: fits}, n // fits))
        if n % fits:
            groups.setdefault(capacity - n % fits * length, []).append(({length: n % fits}, 1))
    return [x for g in groups.values() for x in g]


def first_weights(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return lengths * (lengths / capacity) ** LEAN


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]], float]:
    """Of the programme and of best fit (copies by length, number of such sequences), covering the histogram exactly; and the programme's lower bound.

    While the result is over a sequence above the bound, what was left to best fit becomes dearer and the programme is
    solved again, ``ROUNDS`` times at most; the least result stays.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=np.int64)
    full = histogram.get(capacity, 0)
    lower, best = lower_bound(lengths, counts, capacity), None
    weights = first_weights(lengths, capacity)
    for _ in range(ROUNDS if len(lengths) else 0):
        used, left = rounded(fractional(lengths, counts, weights, capacity), lengths, counts, weights, capacity)
        rest = left > 0
        found = [({int(lengths[j]): n for j, n in pattern.items()}, times) for pattern, times in used], best_fit(lengths[rest].tolist(), left[rest].tolist(), capacity)
        total = sum(n for part in found for _, n in part)
        if best is None or total < best[0]:
            best = total, found
        if total <= math.ceil(lower - 1e-9) + 1:
            break
        weights = weights * np.exp(RISE * left / counts)
    programme, rest = best[1] if best else ([], [])
    return programme + ([({capacity: 1}, full)] if full else []), rest, lower + full


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(copies by length, number of such sequences), covering the histogram exactly."""
    programme, rest, _ = solve(histogram, capacity)
    return programme + rest


def places(chosen: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, runs of ranks in rising order: first rank, copies in a sequence, first sequence, offset of the first copy."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for pattern, times in chosen:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            runs.setdefault(length, []).append((given.get(length, 0), copies, first, offset))
            given[length] = given.get(length, 0) + copies * times
            offset += copies * length
        first += times
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def _placed(runs: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine, known = np.flatnonzero(length == n), runs[n]
                at = known[np.searchsorted(known[:, 0], rank[mine], side="right") - 1]
                within = rank[mine] - at[:, 0]
                sequence[mine] = at[:, 2] + within // at[:, 1]
                offset[mine] = at[:, 3] + within % at[:, 1] * n
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(rows.mapInArrow(_tokenised(tokenizer_path, capacity), _PIECES), "pieces")
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(_placed(places(plan(histogram, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
