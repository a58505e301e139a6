"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Each window of a text, a word in a fixed
carrier, is compressed with either, and the bytes that the toxic dictionary saves are its distance. How many of a text's
windows lie beyond each of several distances, calibrated on labelled texts, gives a probability.

The carrier is in both dictionaries, so that even a short window makes a compressed block and every byte of it counts.
Dictionary content is what training picks: the words that are frequent on one side, the most frequent nearest the end.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.store import Scratch

#: Before and after a window: the first is in both dictionaries, the second in neither, as no match starts in the last bytes.
CARRIER, END = b"qzj0xv1kw2yb3 qgf4zp5hd6rm7 ql8cn9ts0 ", bytes(range(1, 9))
DICTIONARY_BYTES = 16 << 10
#: Labelled texts that a model is fitted on at most, smallest hash of the id first.
MOST_LABELS = 8_000
#: Bytes of a word's beginning by which toxic words are told, and how much likelier in toxic texts (log) it must be.
BEGINNING, LEAST_ODDS = 5, 2.0
#: Distances at which windows are counted.
STEPS = (2, 3, 4, 5, 6, 7, 8)
#: Distances over a window's length at which windows are counted, too.
SHARES = (0.65, 0.72, 0.78, 0.84)
#: Numbers that say what the distances of a text are.
FACTS = len(STEPS) + len(SHARES) + 3
#: Parts of the labelled texts, each calibrated with dictionaries from the others.
FOLDS = 3
#: Words whose distance is remembered, and windows compressed at once.
REMEMBERED, BATCH = 1 << 19, 1 << 13
THRESHOLD = 0.3
PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|"


def windows(text: str | None) -> set[bytes]:
    """The different words of the whole text, in lower case and without outer punctuation."""
    return {x for w in text.lower().encode("utf-8", "surrogatepass").split() if (x := w.strip(PUNCTUATION))} if text else set()


@dataclass
class Model:
    """Both dictionaries and the calibration; ``weights`` empty: one probability for all."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float


class Distances(dict):
    """Bytes that the toxic dictionary saves on a word, and the same over the word's length; remembered."""

    def __init__(self, model: Model):
        super().__init__()
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=6, target_length=64, window_log=15, hash_log=12, chain_log=12,
                                                     search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def of(self, words: list[bytes]) -> np.ndarray:
        """(saved, saved over length) of each word."""
        out = np.zeros((len(words), 2))
        for i in range(0, len(words), BATCH):
            parts = [CARRIER + b" " + w + b" " + END for w in words[i:i + BATCH]]
            toxic, ordinary = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(parts)), float, len(parts)) for c in self.by)
            out[i:i + BATCH, 0] = ordinary - toxic
            out[i:i + BATCH, 1] = (ordinary - toxic) / [len(w) for w in words[i:i + BATCH]]
        return out

    def learn(self, words: list[bytes]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        self.update(zip(words, map(tuple, self.of(words).tolist())))


def facts(d: np.ndarray) -> list[float]:
    """Of a text's distances (saved, saved over length): windows beyond each step, how many there are, and shares of two."""
    over = [int((d[:, 0] >= x).sum()) for x in STEPS] + [int(((d[:, 1] >= x) & (d[:, 0] >= 3)).sum()) for x in SHARES]
    return [*(math.log1p(x) for x in over), math.log1p(len(d)), *(math.log1p(100 * over[k] / max(1, len(d))) for k in (1, -2))]


def evidence(texts: list[str | None], distances: Distances) -> np.ndarray:
    out = []
    for t in texts:
        ws = windows(t)
        if new := [w for w in ws if w not in distances]:
            if len(distances) + len(new) > REMEMBERED:
                new = list(ws)
            distances.learn(new)
        out.append(facts(np.array([distances[w] for w in ws], float).reshape(-1, 2)))
    return np.array(out, float).reshape(len(texts), FACTS)


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Calibration on each third of the labelled texts with dictionaries from the others; the dictionaries that are used
    then come from all. Texts are held as numbers of words, each word once.

    Toxic texts are mostly ordinary words: the toxic dictionary takes from them the words whose beginnings are far more
    frequent in toxic texts than in ordinary ones. Without both classes the model is the smoothed share of toxic texts.
    """
    y = np.array(toxic, int)
    base = float((y.sum() + 1) / (len(y) + 2))
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", none, none, none, base)
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in windows(t)), np.int32) for t in texts]
    words = sorted(number)
    place = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        place[number[w]] = i
    del number
    docs = [place[d] for d in docs]
    starts: dict[bytes, int] = {}
    start_of = np.array([starts.setdefault(w[:BEGINNING], len(starts)) for w in words], np.int32)
    fold = np.arange(len(y)) % FOLDS
    x = np.zeros((len(y), FACTS))
    for f in range(FOLDS):
        model = Model(*_dictionaries(words, start_of, docs, y, fold != f), none, none, none, base)
        own = np.flatnonzero(fold == f)
        used = np.unique(np.concatenate([docs[i] for i in own])) if len(own) else np.zeros(0, np.int32)
        d = Distances(model).of([words[i] for i in used])
        for i in own:
            x[i] = facts(d[np.searchsorted(used, docs[i])])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), y.astype(float))
    return Model(*_dictionaries(words, start_of, docs, y, fold >= 0), mean, scale, weights, base)


def _dictionaries(words: list[bytes], start_of: np.ndarray, docs: list[np.ndarray], y: np.ndarray, learn: np.ndarray) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary from the texts marked in ``learn``."""
    def count(of, size, k):
        parts = [of(docs[i]) for i in np.flatnonzero(learn & (y == k))]
        return np.bincount(np.concatenate(parts), minlength=size) if parts else np.zeros(size, int)
    n = [int((learn & (y == k)).sum()) for k in (0, 1)]
    in_words = [count(lambda d: d, len(words), k) for k in (0, 1)]
    in_starts = [count(lambda d: np.unique(start_of[d]), int(start_of.max()) + 1 if len(words) else 1, k) for k in (0, 1)]
    odds = np.log((in_starts[1] + 0.5) / (n[1] + 1)) - np.log((in_starts[0] + 0.5) / (n[0] + 1))
    told = ((in_starts[1] >= 2) & (odds > LEAST_ODDS))[start_of] if len(words) else np.zeros(0, bool)

    def pick(counts: np.ndarray, size: int) -> bytes:
        order = np.argsort(-counts, kind="stable")[:size]
        return b" ".join([b"", *[words[i] for i in order[::-1] if counts[i] > 0], b""])[-size:]
    plain, telling = pick(np.where(told, 0, in_words[0]), DICTIONARY_BYTES), pick(np.where(told, in_words[1], 0), DICTIONARY_BYTES // 2)
    return plain[-DICTIONARY_BYTES // 2:] + telling + CARRIER, plain + CARRIER


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by damped Newton steps."""
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probabilities(model: Model, texts: list[str | None], distances: Distances | None) -> np.ndarray:
    if not len(model.weights):
        return np.full(len(texts), model.base)
    x = (evidence(texts, distances) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[1:] + model.weights[0], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELS) -> Model:
    """A model of the labelled rows (doc_id, label) that are no held-out rows: at most ``most`` of them, with the smallest
    hashes of the id, come to the driver. Null labels and ids take no part; an id with both labels counts as toxic."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = sorted(texts.collect(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return fit([r["text"] for r in rows], [int(r["y"]) for r in rows])


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic; a column of that name is replaced. Null and empty texts have
    no windows and get what the calibration says of that."""
    docs = docs.drop(name)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def job(batches):
        distances = Distances(model) if len(model.weights) else None
        for b in batches:
            scores = probabilities(model, b.column(at).to_pylist(), distances)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(job, schema)


def scored(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; rows without an id are not held out."""
    found = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
