"""Substring deduplication by hashing lines and the sentences within them.

A unit is a line, or a sentence of a line that holds several, of some least number of words. Units are normalised (case,
punctuation and spacing), digests are grouped over the whole corpus, the earliest occurrence stays and the others go,
each with its offsets in the original text. Passages are found besides, wherever in a line they begin: every window of 50
words that occurs earlier, joined to maximal spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.shingles import WordHashes
from chorale.llm.store import Scratch

LEAST_WORDS = 8
#: Words of a passage, and of the windows among which anchors are chosen; each passage holds an anchor.
PASSAGE, GRAM = 50, 16
SENTENCE = re.compile(r"[.!?][^\w\s]*[ \t]+")
WORD = re.compile(r"[^\W_]+")


def units(text: str | None, least: int = LEAST_WORDS, least_line: int | None = None, across: bool = False) -> list[tuple[str, int, int, bytes, int]]:
    """(level, start, stop, digest, nth) of the units of a text, in order; nth counts earlier equal units of the text.
    Code points, stop exclusive, outer blanks left out; units without enough words have no place here. Lines may have a
    least number of words of their own. ``across``: equal lines and sentences are one unit."""
    out, seen = [], {}
    if not text:
        return out

    def add(level: str, a: int, b: int, line: bytes | None = None) -> bytes | None:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        piece = piece.strip()
        words = WORD.findall(piece.lower())
        if len(words) >= (least if level == "sentence" or least_line is None else least_line):
            digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
            if across and digest == line:  # all words of its line
                return None
            key = "" if across else level, digest
            nth = seen[key] = seen.get(key, -1) + 1
            out.append((level, a, a + len(piece), digest, nth))
            return digest

    at = 0
    for line in text.split("\n"):
        whole = add("line", at, at + len(line))
        cuts = [0, *(m.end() for m in SENTENCE.finditer(line) if m.end() < len(line)), len(line)]
        if len(cuts) > 2:
            for a, b in zip(cuts, cuts[1:]):
                add("sentence", at + a, at + b, whole)
        at += len(line) + 1
    return out


def repeated_units(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, least_line: int | None = None,
                   across: bool = False) -> DataFrame:
    """(doc_id, level, start, stop, first_doc_id): the occurrences to remove, all but the earliest of each unit.

    Occurrences rank by doc_id, null last, then by place. A unit that its own document repeats goes from the second time
    on, with that document as first. Rows that repeat an id share its rank: their first occurrences all stay; so do those
    of rows without an id where no document with an id holds the unit. Null and empty texts have no units.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def job(batches):
        for b in batches:
            ids, cols = b.column(0).to_pylist(), ([], [], [], [], [], [])
            for d, t in zip(ids, b.column(1).to_pylist()):
                for u in units(t, least, least_line, across):
                    for c, v in zip(cols, (d, *u)):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield _batch(cols)
                    cols = ([], [], [], [], [], [])
            yield _batch(cols)

    found = scratch.cut(rows.mapInArrow(job, "doc_id long, level string, start long, stop long, digest binary, nth long"))
    keys = ["digest"] if across else ["level", "digest"]
    groups = found.where("nth = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
    shared = groups.where("docs > 1").select(*keys, "first", F.lit(True).alias("shared"))
    all_units = found.join(shared, keys, "left")
    later = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    return all_units.where(later | (F.col("nth") > 0)).select("doc_id", "level", "start", "stop", F.when(F.col("shared"), F.col("first")).otherwise(F.col("doc_id")).alias("first_doc_id"))


def _windows(text: str | None, memo: WordHashes) -> tuple:
    """Offsets of the words of a text, hashes of its windows of ``GRAM`` words and of 32; nothing for under ``PASSAGE`` words."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    if len(spans) < PASSAGE:
        return spans, None, None
    g = np.fromiter((memo[text[a:b].lower().encode("utf-8", "surrogatepass")] for a, b in spans), np.uint64, len(spans))
    for step in (1, 2, 4, 8, 16):
        if step == GRAM:
            short = g
        g = (g[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (g[step:] + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        g ^= g >> np.uint64(29)
    return spans, short.view(np.int64), g.view(np.int64)


def repeated_passages(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level, start, stop, first_doc_id): maximal spans of windows of ``PASSAGE`` words that occur in a document
    of smaller id (null last), or earlier and apart in their own. ``first_doc_id`` is the smallest id that holds one of them.

    The least hash of every ``PASSAGE - GRAM + 1`` windows of ``GRAM`` words in turn is an anchor, in all copies alike.
    Only about anchors that occur twice are all windows of ``PASSAGE`` words grouped. Rows of one id and text are one."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("text is not null")
    reach = PASSAGE - GRAM + 1

    def anchors(batches):
        memo = WordHashes()
        for b in batches:
            for d, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                _, g, _ = _windows(t, memo)
                if g is not None:
                    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, reach).argmin(axis=1) + np.arange(len(g) - reach + 1))
                    h, n = np.unique(g[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(h), pa.int64()), pa.array([th] * len(h), pa.int64()), pa.array(h), pa.array(n)], names=["doc_id", "th", "h", "n"])

    found = scratch.cut(rows.mapInArrow(anchors, "doc_id long, th long, h long, n long"))
    shared = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    wanted = found.join(shared, "h").groupBy("doc_id", "th").agg(F.collect_set("h").alias("hs")).withColumnsRenamed({"doc_id": "w_id", "th": "w_th"})
    near = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("doc_id", "th", "text", "hs")

    def windows(batches):
        memo = WordHashes()
        for b in batches:
            for d, th, t, hs in zip(*(c.to_pylist() for c in b.columns)):
                spans, g, wide = _windows(t, memo)
                marked = np.concatenate([[0], np.cumsum(np.isin(g, np.array(hs, np.int64)))])
                at = np.flatnonzero(marked[reach:] > marked[:-reach])
                x, y = wide[at], wide[at + PASSAGE - 32]
                _, first, back = np.unique(x * np.int64(3) ^ y, return_index=True, return_inverse=True)
                a, z = [spans[i][0] for i in at], [spans[i + PASSAGE - 1][1] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array(x), pa.array(y), pa.array(at), pa.array(a, pa.int64()), pa.array(z, pa.int64()),
                                                  pa.array(at >= at[first][back] + PASSAGE)], names=["doc_id", "th", "x", "y", "pos", "start", "stop", "again"])

    every = scratch.cut(near.mapInArrow(windows, "doc_id long, th long, x long, y long, pos long, start long, stop long, again boolean"))
    firsts = every.groupBy("x", "y").agg(F.min("doc_id").alias("first"))
    later = every.join(firsts, ["x", "y"]).where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first")))
    texts = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "start", "stop", "first"))).alias("w"))

    def joined(batches):
        for b in batches:
            out = []
            for d, ws in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                end = None
                for w in ws:
                    if end is None or w["pos"] > end:
                        out.append([d, "passage", w["start"], w["stop"], w["first"]])
                    else:
                        out[-1][3] = w["stop"]
                        out[-1][4] = min((f for f in (out[-1][4], w["first"]) if f is not None), default=None)
                    end = w["pos"] + PASSAGE
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "level", "start", "stop", "first_doc_id"])

    return texts.mapInArrow(joined, "doc_id long, level string, start long, stop long, first_doc_id long")


def _batch(cols) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "level", "start", "stop", "digest", "nth"])


def stripped(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed spans, and ``kept_spans``: the pieces of the original text that are left, in order.
    Ids must be unique here; a text that loses nothing, and null, stays as it is."""
    spans = removed.groupBy(F.col("doc_id").alias("d_")).agg(F.collect_set(F.struct("start", "stop")).alias("gone_"))
    gone = F.array_sort(F.coalesce("gone_", F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")))
    # the pieces between spans: a span that lies within what is already gone leaves no piece
    step = lambda acc, s: F.struct(F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("stop"))))).otherwise(acc["kept"]).alias("kept"), F.greatest(acc["at"], s["stop"]).alias("at"))
    start = F.struct(F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)").alias("kept"), F.lit(0).cast("long").alias("at"))
    end = F.length(text).cast("long")
    whole = F.aggregate(gone, start, step, lambda acc: F.when(end > acc["at"], F.concat(acc["kept"], F.array(F.struct(acc["at"].alias("start"), end.alias("stop"))))).otherwise(acc["kept"]))
    out = docs.join(spans, F.col(doc_id) == F.col("d_"), "left").withColumn("kept_spans", F.when(F.col(text).isNotNull(), whole))
    joined = F.array_join(F.transform("kept_spans", lambda s: F.substring(F.col(text), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))), "")
    return out.withColumn(text, joined).drop("d_", "gone_")
