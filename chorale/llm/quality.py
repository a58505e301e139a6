"""Quality by histogram gradient-boosted trees over document statistics.

Every text becomes a row of numbers; trees are grown on histograms of binned features and kept as flat arrays that numpy
walks for all rows and trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.store import Scratch

#: Labelled rows that a model is fitted on at most, smallest hash of the id first.
MOST_LABELS = 40_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.7

STATISTICS = ("log_chars", "log_words", "log_lines", "word_length", "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines", "words_a_line",
              "upper", "lower", "digit", "space", "other_ascii", "non_ascii", "sentence_ends", "bangs", "bars", "symbols", "no_letter", "short_words", "long_words", "packed")
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 4
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c")):
    _CLASS[list(_set)] = _i


def statistics(text: str | None) -> list[float]:
    """The numbers of ``STATISTICS`` for a whole text; zeros for null and empty ones."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / n
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    lengths = [len(x) for x in words]
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(lengths) / w, len(counts) / w, max(counts.values(), default=0) / w,
            sum(a == b for a, b in zip(words, words[1:])) / w, pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
            *kinds, (raw.count(b".") + raw.count(b"?")) / w, raw.count(b"!") / w, raw.count(b"|") / w,
            sum(raw.count(c) for c in (b"#", b"$", b"%", b"&", b"*")) / w, sum(not (x[0] > 127 or x.isalpha() or x[:-1].isalpha()) for x in words) / w,
            sum(x < 3 for x in lengths) / w, sum(x > 12 for x in lengths) / w, len(zlib.compress(raw[:], 1)) / n]


@dataclass
class Trees:
    """Complete trees of equal depth: inner node ``i`` of tree ``t`` tests ``feature[t, i]`` against ``cut[t, i]`` and goes
    on to node 2i+1, or 2i+2 if greater; leaves have values. Their sum over trees and ``base`` is a log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.value)
        if not t or not n:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        depth = int(np.log2(self.value.shape[1]))
        trees = np.arange(t)[None, :]
        node = np.zeros((n, t), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (np.take_along_axis(x, self.feature[trees, node], axis=1) > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node - (2 ** depth - 1)].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for labels 0 and 1 by logistic loss. Nodes are split level by level on the sums of gradients and curvatures
    per feature, node and bin; a node without a useful split sends everything left. One class only: no trees."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            pick = np.full((width, 2), -1)
            for j in range(x.shape[1]):
                key = (node - first) * BINS + bins[:, j]
                gs, hs, ns = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                gain = gs ** 2 / (hs + RIDGE) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + RIDGE) - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE)
                gain[(ns < LEAST_ROWS) | (ns[:, -1:] - ns < LEAST_ROWS)] = 0
                gain[:, len(cuts[j]):] = 0
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best
                best[better] = gain[np.arange(width), b][better]
                pick[better, 0], pick[better, 1] = j, b[better]
            for k in np.flatnonzero(pick[:, 0] >= 0):
                out.feature[t, first + k], out.cut[t, first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        out.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += out.value[t, leaf]
    return out


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def job(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return rows.mapInArrow(job, "doc_id long, x array<float>")


def scored(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The trees are grown on labelled rows that are not held out: at most ``most`` of them, those with the smallest hashes
    of the id, whose numbers (no texts) come to the driver. Null labels and ids take no part; an id with both labels
    counts as 0. Null and empty texts have statistics of zero and a score like others; rows without an id are not held
    out. Without labels, or with one class, the score is the smoothed share of 1 for all.
    """
    seen = scratch.cut(described(docs))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most)
    rows = seen.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).orderBy("doc_id").collect()
    model = grow(np.array([r["x"] for r in rows], np.float32).reshape(len(rows), len(STATISTICS)).astype(float), np.array([r["y"] for r in rows], int))

    def job(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS)).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probabilities(x), pa.float64())], names=["doc_id", "score"])

    found = seen.mapInArrow(job, "doc_id long, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
