"""Periodic runs: stretches of words that repeat with a fixed distance, found tile by tile and stitched.

Periods are cut into octaves (b, 2b]. A run of at least three periods holds, among the places i where word i equals word
i + q, a whole aligned block of b places; so in tiles of each octave every block boundary c is matched against all
c + q of the octave by hashes of b words, and from the blocks that match the places are followed both ways to where they
end, or to the tile's end, which is what a Z-function at the boundary says. Tiles overlap, so that each part of a run
lies in a fragment, and are solved independently of each other. Fragments are then shuffled by document and period and
stitched. The work of a text of n words is in proportion to n log n, whatever the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chorale.llm.shingles import slices

#: Words of a tile that serves all octaves up to its 32nd part; longer octaves have tiles of 32 blocks.
TILE = 1 << 15
#: Words of the smallest block, and of the longest one by which places are followed.
BLOCK, STRIDE = 8, 1 << 10
#: A run has this many words at least, and this many periods.
LEAST, TIMES = 24, 3


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _join(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of 2 * step words from those of step words."""
    return _mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F))


class Blocks:
    """Hashes of all blocks of 2^j words of a tile; above ``STRIDE`` only of the two longest made so far."""

    def __init__(self, ids: np.ndarray):
        self.by, self.longest = {1: _mix(ids.astype(np.uint64) + np.uint64(1))}, 1

    def of(self, size: int) -> np.ndarray:
        while self.longest < size:
            self.by[2 * self.longest] = _join(self.by[self.longest], self.longest)
            self.longest *= 2
            for old in [s for s in self.by if STRIDE < s < self.longest // 2]:
                del self.by[old]
        return self.by[size]

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i equal n words from j, for n within the two longest blocks."""
        out = np.zeros(len(i), bool)
        for size in (self.longest // 2, self.longest):
            now = (n >= size) & (n < 2 * size)
            h, a, b, rest = self.of(size), i[now], j[now], n[now] - size
            out[now] = (h[a] == h[b]) & (h[a + rest] == h[b + rest])
        return out


def _smallest_factor(top: int, _memo: list = [np.zeros(2, np.int64)]) -> np.ndarray:
    if len(_memo[0]) <= top:
        spf = np.arange(2 * top + 2)
        for p in range(2, int(len(spf) ** 0.5) + 1):
            if spf[p] == p:
                part = spf[p * p::p]
                part[part == np.arange(p * p, len(spf), p)] = p
        _memo[0] = spf
    return _memo[0]


def _primitive(blocks: Blocks, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from ``at`` are not a shorter stretch repeated."""
    good, rest, spf = np.ones(len(q), bool), q.copy(), _smallest_factor(int(q.max(initial=2)))
    while (rest > 1).any():
        r = np.where(rest > 1, spf[rest], 1)
        part = q // r
        test = (rest > 1) & good
        n = (q - part)[test]
        same = np.zeros(len(n), bool)
        near = n < blocks.longest // 2  # only below the smallest octave: few words, compared one by one
        a, d = at[test], part[test]
        far = ~near
        same[far] = blocks.equal(a[far], a[far] + d[far], n[far])
        one = blocks.of(1)
        for k in np.flatnonzero(near):
            same[k] = np.array_equal(one[a[k]:a[k] + n[k]], one[a[k] + d[k]:a[k] + d[k] + n[k]])
        good[np.flatnonzero(test)[same]] = False
        rest = rest // r
    return good


def _follow(blocks: Blocks, at: np.ndarray, q: np.ndarray, n: int, forward: bool, most: int) -> np.ndarray:
    """How many of up to ``most`` places from ``at`` on (or before it) hold words equal to those q later, in a tile of n words."""
    got, live = np.zeros(len(at), np.int64), np.arange(len(at))
    size = min(STRIDE, 1 << (max(1, most).bit_length() - 1))
    while size:
        h = blocks.of(size)
        a = at[live] + got[live] if forward else at[live] - got[live] - size
        fits = (a >= 0) & (a + q[live] + size <= n)
        same = np.zeros(len(live), bool)
        same[fits] = h[a[fits]] == h[a[fits] + q[live][fits]]
        got[live[same]] += size
        if size == STRIDE and same.any():
            live = live[same]  # as long as whole strides match; the others end within one
            continue
        live = np.arange(len(at)) if size == STRIDE else live
        size //= 2
    return got


def solve(ids: np.ndarray, octaves: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per octave (block, base), which has periods base + 1 to base + block: (periods, starts, ends) of the stretches of
    places i with ids[i] = ids[i + q] that hold a whole aligned block, where the first q words are primitive."""
    out, blocks, n = [], Blocks(ids), len(ids)
    for block, base in octaves:
        if n < base + 1 + block:
            break
        h = blocks.of(block)
        rows = -(-(len(h) - base - 1) // block)
        ahead = np.zeros(rows * block, np.uint64)
        ahead[:len(h) - base - 1] = h[base + 1:]
        hit = ahead.reshape(rows, block) == h[:rows * block:block][:rows, None]
        hit.ravel()[len(h) - base - 1:] = False
        if not hit.any():
            continue
        r, j = np.nonzero(hit.T)
        new = np.append(True, (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1))
        last = np.append(new[1:], True)
        q, x, y = r[new] + base + 1, j[new] * block, (j[last] + 1) * block
        keep = _primitive(blocks, x, q)
        q, x, y = q[keep], x[keep], y[keep]
        if len(q):
            out.append((q, x - _follow(blocks, x, q, n, False, block), y + _follow(blocks, y, q, n, True, block)))
    return out


def octaves_of(n: int) -> list[tuple[int, int]]:
    """(block, base) of all octaves with a period of which ``TIMES`` fit into n words."""
    out = [(BLOCK, 0)]
    while TIMES * (max(BLOCK, out[-1][1] * 2) + 1) <= n:
        base = max(BLOCK, out[-1][1] * 2)
        out.append((base, base))
    return out


def tiles(n: int, tile: int = TILE) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, stop, octaves) of the tiles of n words. Tiles of an octave overlap by four of its blocks, so that a stretch
    of places of which one tile holds less than an aligned block lies in its neighbour."""
    every = octaves_of(n)
    if n <= tile:
        return [(0, n, every)]
    low = [o for o in every if o[0] * 32 <= tile]
    out = []
    for size, some in [(tile, low), *((o[0] * 32, [o]) for o in every if o[0] * 32 > tile)]:
        step = size - 4 * some[-1][0]
        for start in range(0, n, step):
            out.append((start, min(n, start + size), some))
            if start + size >= n:
                break
    return out


def fragments_of(ids: np.ndarray, tile: int = TILE) -> list[tuple[int, int, int]]:
    """(period, start, end) of stretches of equal places: those long enough, and those that a tile's end may have cut."""
    out, n = [], len(ids)
    if n < LEAST:
        return out
    for a, z, octaves in tiles(n, tile):
        for q, x, y in solve(ids[a:z], octaves):
            cut = ((x == 0) & (a > 0)) | ((y + q == z - a) & (z < n))
            keep = cut | (y - x + q >= np.maximum(LEAST, TIMES * q))
            out += zip(q[keep].tolist(), (x[keep] + a).tolist(), (y[keep] + a).tolist())
    return out


def numbered(w: list[bytes]) -> np.ndarray:
    """Words as numbers that are equal where the words are."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(d, th, start, length, period): every run of each text, words numbered from 0. A run is a stretch of consecutive
    words with smallest period q, of max(``LEAST``, ``TIMES`` * q) words at least, that no neighbouring word extends.

    Words are what ASCII white space parts. ``d`` is the id and ``th`` a hash of the text; rows that repeat both share
    their runs. Null and empty texts, and those of under ``LEAST`` words, have none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t")).where(F.length("t") >= 2 * LEAST - 1)

    def job(batches):
        for b in slices(batches):
            out = [[], [], [], [], []]
            for d, th, t in zip(*(c.to_pylist() for c in b.columns)):
                for found in fragments_of(numbered(words(t)), tile):
                    for c, v in zip(out, (d, th, *found)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d", "th", "q", "x", "y"])

    found = rows.mapInArrow(job, "d long, th long, q long, x long, y long").distinct()
    own = Window.partitionBy("d", "th", "q").orderBy("x", "y")
    reached = F.max("y").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", F.when(F.col("x") <= reached, 0).otherwise(1)).withColumn("part", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("d", "th", "q", "part").agg(F.min("x").alias("start"), (F.max("y") + F.col("q") - F.min("x")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("q"))).select("d", "th", "start", "length", F.col("q").alias("period"))


def collapsed(w: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are not in any run (start, length, period) after its first period."""
    if not runs:
        return w
    edge = np.zeros(len(w) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with columns ``runs`` (array of start, length, period; by start, then period), ``strongest`` (the run with
    the greatest length / period, ties to the smaller start, then period; null without a run) and ``collapsed`` (the words
    outside runs and those of each run's first period, joined by one space), which replace columns of these names.

    Null and empty texts have no runs and an empty ``collapsed``; rows that repeat an id and text are judged alike, rows
    without an id each by their text; no rows give no rows."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("i_"), F.xxhash64(text).alias("h_"), F.col(text).alias("t_"))
    found = periodic_runs(docs, doc_id, text, tile)
    lists = found.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))  # at most n / 8 runs of n words
    met = rows.where("t_ is not null").join(lists, F.col("i_").eqNullSafe(F.col("d")) & (F.col("h_") == F.col("th")), "left").select("row", "t_", "runs")
    run = "struct<start: bigint, length: bigint, period: bigint>"
    every = met.union(rows.where("t_ is null").select("row", "t_", F.expr(f"cast(null as array<{run}>)").alias("runs")))
    shape = StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, strongest struct<start: bigint, length: bigint, period: bigint>, collapsed string")
    arrow = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf(shape)
    def judged(texts: pa.Array, runs: pa.Array) -> pa.Array:
        parts = [part(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in slices([pa.RecordBatch.from_arrays([texts, runs], names=["t", "r"])])]
        return pa.concat_arrays(parts) if parts else part([], [])

    def part(texts: list, runs: list) -> pa.Array:
        lists, best, kept = [], [], []
        for t, rs in zip(texts, runs):
            w, rs = words(t), rs or []
            top = None
            for x in rs:  # in order of start and period: only a greater ratio takes the place
                if top is None or x["length"] * top["period"] > top["length"] * x["period"]:
                    top = x
            lists.append(rs)
            best.append(top)
            kept.append(b" ".join(collapsed(w, [(x["start"], x["length"], x["period"]) for x in rs])).decode("utf-8", "surrogatepass"))
        return pa.StructArray.from_arrays([pa.array(lists, pa.list_(arrow)), pa.array(best, arrow), pa.array(kept, pa.string())], names=["runs", "strongest", "collapsed"])

    made = ("runs", "strongest", "collapsed")
    out = every.select("row", judged("t_", "runs").alias("made"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in made], *[F.col("made").getField(c).alias(c) for c in made])
