"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most ``BINS`` bins. Cyclic boosting takes the features in turn
and fits a tree of up to three leaves to the logistic loss; as a tree of one feature is a step function, it
is added to that feature's lookup table. The pairs whose best four-quadrant tree gains most on what is left
then get two-dimensional tables in the same way. A score is a sum of table entries, for a whole batch at once.

Learning takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest hashes of doc_id. Features are
measured on the whole of every text.

Defined cases: a null text counts as empty and has a score like any other; labels that are null are left out;
a doc_id with several labels counts as 1 if any is, one with several texts by the text of the least hash; without labels, or with labels of one kind, all scores are
the share of label 1 (smoothed). Rows are scored one by one, so repeated rows and null doc_ids just stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import fresh

#: Most rows that learning takes, and the model's sizes.
TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.15
CUT = 0.3

FEATURES = (
    "log_chars", "word_length", "upper", "digits", "punctuation", "symbols", "bars", "exclamations", "lines",
    "distinct_words", "commonest_word", "repeated_next", "distinct_lines", "commonest_line", "longest_word", "other_bytes", "byte_entropy", "closed_words",
)
_CLASS = np.zeros((256, 8))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"$%&#*@^~+=<>/\\_[]{}`", b"|", b"!", b"\n")):
    _CLASS[list(_set), _k] = 1
_CLASS[128:, 7] = 1
_LINE = re.compile("\n")


def features(text: str) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, words = max(1, len(raw)), text.lower().split()
    k = max(1, len(words))
    upper, digits, punctuation, symbols, bars, marks, lines, other = (counts @ _CLASS).tolist()
    p = counts[counts > 0] / n
    rows = [x for x in _LINE.split(text) if x]
    word_counts: dict[str, int] = {}
    for w in words:
        word_counts[w] = word_counts.get(w, 0) + 1
    line_counts: dict[str, int] = {}
    for x in rows:
        line_counts[x] = line_counts.get(x, 0) + 1
    return [
        math.log1p(len(text)), n / k, upper / n, digits / n, punctuation / n, symbols / n, bars / k, marks / k, lines / k,
        math.log(len(word_counts) + 1) / math.log(k + 2), max(word_counts.values(), default=0) / k,
        sum(map(str.__eq__, words, words[1:])) / k, len(line_counts) / max(1, len(rows)), max(line_counts.values(), default=0) / max(1, len(rows)),
        max(map(len, word_counts), default=0), other / n, float(-(p * np.log2(p)).sum()), sum(w[-1] in ".,!?;:" for w in words) / k,
    ]


class Model:
    """Tables of the features and pairs; ``score`` adds up their entries."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), dtype=np.int64)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.base)
        for j, table in enumerate(self.single):
            total += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


_REG = 1.0


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _REG)


def _steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best step function of up to three levels over the bins: the tree splits once, then its better side again."""
    n = len(g)
    out = np.zeros(n)
    spans = [(0, n)]
    for _ in range(2):
        best = (1e-9, -1, -1)
        for at, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gains = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], at, a + k + 1)
        if best[1] < 0:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _REG)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros_like(g)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left, full = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, left - a, full - top - left + a]

    quarters = list(zip(parts(cg), parts(ch), strict=True))
    gains = sum(_gain(x, y) for x, y in quarters) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    v = [float(x[i, j] / (y[i, j] + _REG)) for x, y in quarters]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gains[i, j]), out


def _edges(v: np.ndarray) -> np.ndarray:
    """Half the cuts halve the rows, half the distinct values: rare kinds of text get bins of their own."""
    if not len(v):
        return np.empty(0)
    at = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    return np.unique(np.concatenate((np.quantile(v, at), np.quantile(np.unique(v), at))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn a model; the order of rows does not matter beyond rounding."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, j]) for j in range(len(FEATURES))]
    model = Model(edges, float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return model
    b = model.bins(x)
    margin = model.margin(b)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.single):
            g, h = residuals()
            step = RATE * _steps(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += step
            margin += step[b[:, j]]
    g, h = residuals()
    sizes = [len(t) for t in model.single]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    ranked = sorted((-_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(sizes)) for j in range(i))
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for gain, i, j in ranked[:PAIRS] if gain < 0}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            g, h = residuals()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            margin += step[b[:, i], b[:, j]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "text_key", "x"])


def held_out(doc_id) -> F.Column:
    """Rows that learning never sees: crc32 of doc_id as text divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fifth; their features alone come to the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = {r["doc_id"]: float(r["y"] > 0) for r in known.collect()}
    if not found:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    ids = docs.sparkSession.createDataFrame([(i,) for i in found], "doc_id long")  # at most ``rows`` of them
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    measured = chosen.mapInArrow(_measured, "doc_id long, text_key long, x array<double>")
    # Of several texts with one doc_id the one with the least hash counts, so no more rows come than there are ids.
    got = measured.groupBy("doc_id").agg(F.min(F.struct("text_key", "x")).alias("m")).select("doc_id", "m.x").toPandas().sort_values("doc_id")
    if got.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    return fit(np.stack(got["x"].to_numpy()), np.array([found[i] for i in got["doc_id"]]))


def score_documents(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name`` for the whole of every text; the other columns stay."""
    shared = {"m": model}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared["m"].score(x), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    name = fresh(docs, "quality_score")
    return score_documents(docs, train(docs, labels), name).where(F.col(name) >= CUT).drop(name)
