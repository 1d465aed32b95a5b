"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. Each block has a vector of its tag path, the words of the enclosing
classes and ids, its own words (all hashed), and a few plain measures. A bidirectional LSTM in numpy reads the
sequence, so each label depends on the whole page; blocks that it takes for the article are joined by line breaks.

The weights come from ``html_training``, which draws labelled pages of many designs; ``html_lstm.npz`` holds them.

Defined cases: null html counts as empty; a page without main blocks has the empty text; rows are pages, so
repeated rows, null page_ids and null urls stay as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.html_blocks import Block, blocks

TAGS, NAMES, WORDS, PLAIN = 64, 96, 64, 8
WIDTH = TAGS + NAMES + WORDS + PLAIN
HIDDEN = 24
#: Blocks that are labelled at a time, padding included.
CELLS = 1 << 14
WEIGHTS = Path(__file__).with_name("html_lstm.npz")


@lru_cache(maxsize=1 << 17)
def _slot(kind: str, word: str) -> int:
    size, first = {"t": (TAGS, 0), "n": (NAMES, TAGS), "w": (WORDS, TAGS + NAMES)}[kind]
    return first + zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=1 << 14)
def _path(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[int, ...]:
    """Slots of the enclosing tags, of the innermost ones with their depth from within, and of the names."""
    return tuple({_slot("t", t) for t in tags} | {_slot("t", f"{k}:{t}") for k, t in enumerate(tags[:-4:-1])} | {_slot("n", n) for n in names})


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all the pages."""
    flat, at, weight, plain = [], [], [], []
    for page in pages:
        for k, b in enumerate(page):
            row, words = len(plain), b.text.lower().split()
            path = _path(b.tags, b.names)
            flat += path
            at += [row] * len(path)
            weight += [1.0] * len(path)
            flat += [_slot("w", w) for w in words]
            at += [row] * len(words)
            weight += [1 / math.sqrt(len(words))] * len(words)
            n = len(b.text)
            plain.append((
                math.log1p(n) / 6, math.log1p(len(words)) / 4, min(1.0, b.linked / n), sum(map(b.text.count, ".,;!?")) / len(words),
                "©" in b.text, k / len(page), 1 / (1 + k), 1 / (len(page) - k),
            ))
    x = np.bincount(np.array(at, dtype=np.int64) * WIDTH + np.array(flat, dtype=np.int64), weight, len(plain) * WIDTH).reshape(-1, WIDTH).astype(np.float32) if plain else np.zeros((0, WIDTH), np.float32)
    if plain:
        x[:, -PLAIN:] = plain
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def one_way(z: np.ndarray, recur: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, unit) of an LSTM whose inputs are already projected; gates in the order i, f, o, g."""
    steps, pages, _ = z.shape
    out, h, c = np.zeros((steps, pages, HIDDEN), z.dtype), np.zeros((pages, HIDDEN), z.dtype), np.zeros((pages, HIDDEN), z.dtype)
    for t in range(steps):
        a = z[t] + h @ recur
        s, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        before = c
        c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        r = np.tanh(c)
        h = s[:, 2 * HIDDEN :] * r
        out[t] = h
        if keep is not None:
            keep.append((s, g, before, r))
    return out


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse order, padding left where it is."""
    out = x.copy()
    for p, n in enumerate(lengths):
        out[:n, p] = x[:n, p][::-1]
    return out


def margins(w: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Log odds, page by page, that a block belongs to the main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        take, order = order[-max(1, CELLS // longest) :], order[: -max(1, CELLS // longest)]
        lengths = np.array([len(pages[i]) for i in take])
        x = vectors([pages[i] for i in take])
        total = np.zeros((longest, len(take)), np.float32)
        row = np.concatenate([np.arange(n) for n in lengths])
        page = np.repeat(np.arange(len(take)), lengths)
        for way, flip in (("f", False), ("b", True)):
            z = np.zeros((longest, len(take), 4 * HIDDEN), np.float32)
            z[(lengths[page] - 1 - row) if flip else row, page] = x @ w[f"{way}_in"] + w[f"{way}_bias"]
            h = one_way(z, w[f"{way}_recur"])
            total += turned(h, lengths) @ w[f"{way}_out"] if flip else h @ w[f"{way}_out"]
        for k, i in enumerate(take):
            out[i] = total[: lengths[k], k] + w["bias"]
    return out


def load(path: Path | str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def main_texts(w: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [blocks(p or "") for p in pages]
    return ["\n".join(b.text for b, m in zip(page, found, strict=True) if m > 0) for page, found in zip(parsed, margins(w, parsed), strict=True)]


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    w = weights or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = main_texts(w, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", "html")
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
