"""Hard-negative mining by threshold joins over an inverted index, after L2AP.

A threshold join finds, for queries with a least score each, all rows whose inner product reaches it. In each cell of a
grid of query blocks and row blocks, dimensions are taken in order of their weight in the block. Of every row the longest
tail of dimensions stays out of the index whose norm, times the largest query norm, is under the least score: a pair that
meets in the tail only cannot reach it. Postings are accumulated group of dimensions by group, rows are pruned when
partial score plus the product of the remaining norms falls short for every query, and the scores of those that remain
are completed from the tails.

Searches are windows: the best k rows whose score lies between two bounds. A window is asked for with a high least score
first, which is lowered for those that have not filled, down to the window's own lower bound, where the answer is whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.store import Scratch

#: Queries that accumulate together, and dimensions between two prunings.
STRIPE, GROUP = 32, 16
#: No score is outside these bounds.
LOWEST, HIGHEST = -(2 ** 62), 2 ** 62
#: Least scores of the rounds for positives (parts of the largest possible score; the last round takes all), and for
#: negatives (parts of the positive's score, as far as the window goes).
POSITIVE_ROUNDS = (0.6, 0.4, 0.2)
NEGATIVE_ROUNDS = (0.85, 0.7)


def vectors(df: DataFrame, vec_id: str, label: str, weights: str) -> DataFrame:
    """(r, id, label, v, norm): rows with integer weights that can take part, as bytes of 64-bit numbers; ``r`` numbers
    rows, so write the frame before it is used twice.

    Rows whose label or weights are null, or whose weights hold a null, take no part; nor do those with a weight so large
    that scores might not fit into 64 bits. A null id is kept and comes last among ties."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(weights).cast("array<long>").alias("w")).where(
        "label is not null and w is not null and not exists(w, x -> x is null)")
    most = F.floor(F.sqrt(F.lit(float(2 ** 62)) / F.greatest(F.size("w"), F.lit(1)))) - 1
    rows = rows.where(~F.exists("w", lambda x: (x > most) | (x < -most)))

    def packed(batches):
        for pdf in batches:
            v = [np.asarray(x, np.int64) for x in pdf["w"]]
            norm = [math.sqrt(float((x.astype(np.float64) ** 2).sum())) for x in v]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "label": pdf["label"], "v": [x.tobytes() for x in v], "norm": norm})

    return rows.mapInPandas(packed, "id long, label long, v binary, norm double").withColumn("r", F.monotonically_increasing_id())


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, x in enumerate(rows):
        v = np.frombuffer(x, np.int64)
        out[i, :len(v)] = v
    return out


class Index:
    """The rows of one block, indexed for scores of ``least`` and queries of norm ``high`` at most.

    Scores are exact: in 64-bit floats where every sum stays under 2^53, in integers otherwise."""

    def __init__(self, x: np.ndarray, high: float, least: float, biggest: int):
        exact = float(biggest) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2 ** 53
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        x = x[:, self.order].astype(np.float64 if exact else np.int64)
        square = x.astype(np.float64) ** 2
        # norm of dimensions k and beyond, a little enlarged against rounding
        tail = np.sqrt(np.cumsum(square[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
        self.kept = (tail * high >= least).sum(axis=1) if least > 0 else np.full(len(x), x.shape[1])
        self.rank = np.argsort(-self.kept, kind="stable")  # the posting list of a dimension is a prefix of this order
        self.x, self.kept, self.tail = x[self.rank], self.kept[self.rank], np.hstack([tail, np.zeros((len(x), 1))])[self.rank]

    def search(self, q: np.ndarray, least: np.ndarray):
        """(query position, row position, score) of all pairs with a score of at least the query's ``least``."""
        q = q[:, self.order].astype(self.x.dtype)
        dims = q.shape[1]
        square = q.astype(np.float64) ** 2
        rest = np.hstack([np.sqrt(np.cumsum(square[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9), np.zeros((len(q), 1))])
        live = np.arange(len(self.x))
        part = np.zeros((len(q), len(live)), self.x.dtype)
        for k in range(0, dims, GROUP):
            held = int(np.searchsorted(-self.kept[live], -k, side="left"))  # rows with postings from dimension k on
            at, to = live[:held], min(dims, k + GROUP)
            block = self.x[at, k:to]
            if held and (self.kept[at[-1]] < to):
                block = np.where(np.arange(k, to) < self.kept[at][:, None], block, 0)
            part[:, :held] += q[:, k:to] @ block.T
            # what is left: dimensions of the index after these, and the tail, which lies after all of them
            left = np.where(self.kept[live] >= to, self.tail[live, to], self.tail[live, self.kept[live]])
            bound = np.where(self.kept[live] >= to, rest[:, [to]], rest[:, self.kept[live]])
            stay = (part + left * bound >= least[:, None]).any(axis=0)
            if not stay.all():
                live, part = live[stay], np.ascontiguousarray(part[:, stay])
        tails = np.where(np.arange(dims) >= self.kept[live][:, None], self.x[live], 0)
        score = part + q @ tails.T
        i, j = np.nonzero(score >= least[:, None])
        return i, self.rank[live[j]], score[i, j].astype(np.int64)


def _cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    dims = max(max(map(len, queries["v"])), max(map(len, rows["v"]))) // 8
    x, ids, labels = _matrix(rows["v"], dims), rows["id"].astype("Int64"), rows["label"].to_numpy(np.int64)
    missing = ids.isna().to_numpy()
    ids = ids.fillna(0).to_numpy(np.int64)
    queries = queries.assign(least=queries["lo"].map(min)).sort_values("least", kind="stable")
    out: list = [[], [], [], []]
    index, built = None, None
    for s in range(0, len(queries), STRIPE):
        some = queries.iloc[s:s + STRIPE]
        q = _matrix(some["v"], dims)
        least = some["least"].to_numpy(np.int64)
        if index is None or least.min() > 1.2 * built:
            later = queries.iloc[s:]
            built = int(least.min())
            biggest = max((int(np.abs(np.frombuffer(v, np.int64)).max(initial=0)) for v in later["v"]), default=0)
            index = Index(x, float(later["norm"].max()) * (1 + 1e-9), float(built), biggest)
        i, j, score = index.search(q, least)
        own = some["label"].to_numpy(np.int64)[i]
        anchor = some["id"].to_numpy(np.int64)[i]
        fit = ((labels[j] == own) == same) & (missing[j] | (ids[j] != anchor))
        i, j, score = i[fit], j[fit], score[fit]
        order = np.lexsort((ids[j], missing[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.searchsorted(i, np.arange(len(some) + 1))
        for p, (r, ws, lo, hi) in enumerate(zip(some["r"], some["w"], some["lo"], some["hi"])):
            down = -score[start[p]:start[p + 1]]
            for w, a, z in zip(ws, lo, hi):
                first = start[p] + int(np.searchsorted(down, -z, side="left"))
                last = min(first + k, start[p] + int(np.searchsorted(down, -a, side="right")))
                for at in range(first, last):
                    for c, v in zip(out, (r, w, None if missing[j[at]] else int(ids[j[at]]), int(score[at]))):
                        c.append(v)
    return pd.DataFrame({"r": pd.array(out[0], "Int64"), "w": pd.array(out[1], "Int32"), "found": pd.array(out[2], "Int64"), "score": pd.array(out[3], "Int64")})


def join_windows(windows: DataFrame, rows: DataFrame, k: int, same: bool, row_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(r, w, rank, found, score): of each window (r, id, label, v, norm, w, lo, hi) the k rows of the same label, or of
    others, with lo <= score <= hi and highest scores, ties to smaller ids; rows with the query's id left out.

    Blocks are dealt by hashes of row numbers, so no label, id or run of equal vectors fills one. Each cell holds bounded
    rows and returns k rows per window at most."""
    asked = windows.groupBy("r").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.first("norm").alias("norm"),
                                     F.collect_list(F.struct("w", "lo", "hi")).alias("ws"))  # a query has few windows
    nc, nq = max(1, -(-rows.count() // row_block)), max(1, -(-asked.count() // query_block))
    deal = F.xxhash64("r", F.lit(7))
    q = asked.select(F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), F.pmod(deal, F.lit(nq)).cast("int").alias("qb"), "r", "id", "label", "v", "norm",
                     F.col("ws.w").alias("w"), F.col("ws.lo").alias("lo"), F.col("ws.hi").alias("hi"))
    c = rows.select(F.pmod(deal, F.lit(nc)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "id", "label", "v")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"r": [], "w": [], "found": [], "score": []})
        return _cell(left, right, k, same)

    found = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInPandas(cell, "r long, w int, found long, score long")
    best = Window.partitionBy("r", "w").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("r", "w", "rank", "found", "score")


def filled(windows: DataFrame, rows: DataFrame, k: int, same: bool, rounds: list, scratch: Scratch, **blocks) -> DataFrame:
    """The k best of every window, asked for with the least scores of ``rounds`` (columns over the window) in turn, and
    in the end with the window's own lower bound. A round's answer stands where it filled the window: all rows of higher
    score were seen."""
    parts, open_ = [], windows
    for least in [*rounds, None]:
        asked = open_ if least is None else open_.withColumn("lo", F.greatest("lo", F.ceil(least).cast("long")))
        got = scratch.cut(join_windows(asked, rows, k, same, **blocks))
        if least is None:
            parts.append(got)
            break
        full = got.where(F.col("rank") == k).select("r", "w")
        parts.append(got.join(full, ["r", "w"]))
        open_ = scratch.cut(open_.join(full, ["r", "w"], "left_anti"))
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def hard_negatives(anchors: DataFrame, rows: DataFrame, scratch: Scratch, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **blocks) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its first
    ``positives`` rows of the same label by score, and for each of them the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to smaller ids, null last.

    Both sides come from ``vectors``, written, anchors being some of the rows. Rows with the anchor's own id are left out
    on its side; a row that occurs twice counts twice, as anchor too. A positive of score 0 has negatives of score 0, one
    of a negative score has none. Vectors of different lengths are filled up with zeros. Empty tables give no rows."""
    top = rows.agg(F.max("norm")).first()[0] or 0.0
    ask = anchors.where("id is not null").select("r", "id", "label", "v", "norm")
    whole = ask.withColumns({"w": F.lit(0), "lo": F.lit(LOWEST), "hi": F.lit(HIGHEST)})
    near = scratch.cut(filled(whole, rows, positives, True, [F.col("norm") * F.lit(p * top) for p in POSITIVE_ROUNDS], scratch, **blocks))
    near = near.select("r", F.col("rank").alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = scratch.cut(_bounded(near.join(ask, "r"), low, high).where("lo <= hi"))
    found = filled(windows.drop("positive_id"), rows, negatives, False, [p * F.col("positive_score") for p in NEGATIVE_ROUNDS], scratch, **blocks)
    out = found.join(windows.select("r", "w", F.col("id").alias("anchor_id"), "positive_id", "positive_score"), ["r", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _bounded(windows: DataFrame, low: int, high: int) -> DataFrame:
    """With lo and hi in whole numbers: quotient and remainder apart, so that nothing overflows or is rounded."""
    whole, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    return windows.withColumns({"lo": whole * low - F.floor(-rest * low / F.lit(100)).cast("long"), "hi": whole * high + F.floor(rest * high / F.lit(100)).cast("long")})
