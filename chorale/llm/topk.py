"""Exact top-k search by exhaustive term-at-a-time accumulation.

Sparse integer rows (terms with weights) are searched in a grid of query blocks and candidate blocks. In each cell the
candidates become posting lists; every term's postings, times the queries' weights, are scattered into a dense score
array; partition selection leaves k candidates per query and cell, and Spark merges the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that share one dense score array.
STRIPE = 64


def sparse_rows(df: DataFrame, id_col: str, weights: str) -> DataFrame:
    """(id, terms, weights): one row per id from an array of integer weights; zero weights have no posting.

    Rows whose id or array is null, or whose array holds a null, are left out: they take no part. Of repeated rows of
    one id the smallest array is taken. An empty array scores 0 against everything.
    """
    rows = (
        df.where(F.col(id_col).isNotNull() & F.col(weights).isNotNull() & ~F.exists(weights, lambda x: x.isNull()))
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(weights).alias("w"))
    )
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("t"), x.cast("long").alias("v"))), lambda p: p["v"] != 0)
    return rows.select("id", at.alias("p")).select("id", F.col("p.t").alias("terms"), F.col("p.v").alias("weights"))


def _postings(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids in order, and per term the positions and weights of the rows that hold it."""
    pdf = pdf.sort_values("id", kind="stable")
    counts = pdf["terms"].map(len).to_numpy()
    if not counts.sum():
        return pdf["id"].to_numpy(np.int64), {}
    terms = np.concatenate(pdf["terms"].to_numpy()).astype(np.int64)
    vals = np.concatenate(pdf["weights"].to_numpy()).astype(np.int64)
    rows = np.repeat(np.arange(len(pdf)), counts)
    order = np.argsort(terms, kind="stable")
    terms, vals, rows = terms[order], vals[order], rows[order]
    uniq, start = np.unique(terms, return_index=True)
    ends = np.append(start[1:], len(terms))
    return pdf["id"].to_numpy(np.int64), {int(t): (rows[a:b], vals[a:b]) for t, a, b in zip(uniq, start, ends)}


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    cand, posts = _postings(candidates)
    out = []
    queries = queries.sort_values("id", kind="stable")
    n = len(cand)
    most = max((int(np.abs(v).max()) for _, v in posts.values()), default=0)
    for s in range(0, len(queries), STRIPE):
        ids, asked = _postings(queries.iloc[s:s + STRIPE])
        high = max((int(np.abs(v).max()) for _, v in asked.values()), default=0)
        if most * high * max(1, len(asked)) >= 2 ** 62 // max(n, 1):
            raise OverflowError("scores do not fit into 64 bits")
        small = most * high * max(1, len(asked)) < 2 ** 31
        scores = np.zeros((len(ids), n), np.int32 if small else np.int64)
        for t, (qr, qw) in asked.items():
            if t not in posts:
                continue
            cr, cw = posts[t]
            cw = cw.astype(scores.dtype)
            if len(cr) == n:  # a full posting list needs no scatter
                for r, w in zip(qr, qw):
                    scores[r] += cw * scores.dtype.type(w)
            else:
                for r, w in zip(qr, qw):
                    scores[r, cr] += cw * scores.dtype.type(w)
        key = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)  # ties go to the smaller id
        own = np.searchsorted(cand, ids)
        hit = (own < n) & (cand[np.minimum(own, n - 1)] == ids)
        key[np.flatnonzero(hit), own[hit]] = np.iinfo(np.int64).min
        m = min(k, n)
        best = np.argpartition(key, n - m, axis=1)[:, n - m:]
        r = np.repeat(np.arange(len(ids)), m)
        c = best.ravel()
        keep = key[r, c] != np.iinfo(np.int64).min
        r, c = r[keep], c[keep]
        out.append(pd.DataFrame({"query_id": ids[r], "vec_id": cand[c], "score": scores[r, c].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, candidate_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k highest inner products over all candidates but its own id;
    fewer than k if there are fewer. Ties go to the smaller id.

    Each side has (id, terms, weights), ids unique. Blocks are dealt by a hash of the id, so that no source or run of
    equal vectors fills one; each side is repeated once per block of the other, and a cell holds bounded rows.
    """
    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    nc, nq = blocks(candidates, candidate_block), blocks(queries, query_block)
    deal = F.xxhash64("id", F.lit(7))
    q = queries.select("id", "terms", "weights", F.pmod(deal, F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = candidates.select("id", "terms", "weights", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(deal, F.lit(nc)).alias("cb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _search(left, right, k)

    q = q.select(F.col("cb").cast("int"), F.col("qb").cast("int"), "id", "terms", "weights")
    c = c.select(F.col("cb").cast("int"), F.col("qb").cast("int"), "id", "terms", "weights")
    found = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
