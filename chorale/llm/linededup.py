"""Line deduplication over a corpus: lines that several documents hold stay in one of them only.

Every text is exploded into normalised lines; a 128-bit hash stands for each, distinct documents are counted per hash,
and lines whose count reaches the threshold are dropped by position, after which the rest is joined again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chorale.llm.store import Scratch

#: Blanks that are cut off at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Hashes held by more than one in so many of all (document, hash) rows are hot; there are fewer of them than this.
HOT = 512


def keyed_lines(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """(d, th, a, b, at): one row per text and distinct line key of at least ``least_chars`` code points; (a, b) is the
    key's hash, ``at`` the numbers of its lines, ``th`` a hash of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t")).where(F.length("t") >= max(1, least_chars))

    def job(batches):
        for b in batches:
            lines = pc.split_pattern(pc.ascii_lower(b.column(2)), "\n")
            owner = pc.list_parent_indices(lines).to_numpy()
            flat = pc.ascii_trim(pc.list_flatten(lines), characters=BLANKS)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))])
            pick = np.flatnonzero(pc.greater_equal(pc.utf8_length(flat), least_chars).to_numpy(zero_copy_only=False))
            if not len(pick):
                continue
            digest = b"".join(map(xxhash.xxh3_128_digest, flat.take(pa.array(pick)).cast(pa.binary()).to_pylist()))
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            own = owner[pick].astype(np.int64)
            order = np.lexsort((pick, h[:, 1], h[:, 0], own))
            h, own, place = h[order], own[order], (pick - first[owner[pick]])[order]
            new = np.append(True, (own[1:] != own[:-1]) | (h[1:] != h[:-1]).any(axis=1))
            start = np.flatnonzero(new)
            at = pa.ListArray.from_arrays(pa.array(np.append(start, len(place)), pa.int32()), pa.array(place, pa.int32()))
            who = pa.array(own[start])
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(h[start, 0]), pa.array(h[start, 1]), at], names=["d", "th", "a", "b", "at"])

    return rows.mapInArrow(job, "d long, th long, a long, b long, at array<int>")


def repeated_lines(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least_docs: int = 2, least_chars: int = 10) -> DataFrame:
    """(d, th, gone): per id and text hash the numbers of the lines to drop: lines whose key ``least_docs`` documents
    hold, except in the document of the smallest id among these. Rows of one id are one document; so are all rows
    without an id, which come last. Texts that lose nothing have no row."""
    units = scratch.cut(keyed_lines(docs, doc_id, text, least_chars))
    # counted in two steps, both combined map-side: a line that a third of all documents hold is no hot key
    holders = units.groupBy("a", "b", "d").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.min("d").alias("first"))
    shared = scratch.cut(holders.where((F.col("docs") >= least_docs) & (F.col("docs") > 1)))
    hot = F.col("docs") * HOT > units.count()
    few = F.broadcast(shared.where(hot))  # under HOT rows, as their counts add up to more than all rows otherwise
    gone = units.join(few, ["a", "b"]).union(units.join(few, ["a", "b"], "left_anti").join(shared.where(~hot), ["a", "b"]))
    return gone.where(~F.col("d").eqNullSafe(F.col("first"))).groupBy("d", "th").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


@F.arrow_udf(StringType())
def _kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(texts.to_pylist(), gone.to_pylist()):
        if g:
            drop = set(g)
            t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
        out.append(t)
    return pa.array(out, pa.string())


def without_repeated_lines(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least_docs: int = 2, least_chars: int = 10) -> DataFrame:
    """``docs`` with three columns more, which replace columns of these names: ``n_lines`` of the text, ``n_dropped``,
    and ``kept_text``, the lines that stay, joined by line feeds.

    A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Keys of at least ``least_chars`` code
    points found in at least ``least_docs`` documents lose all their lines except in the document of smallest id that
    holds them, where all stay. Null and empty texts are one empty line; a null text gives an empty one. Rows of one id
    are one document, and so are all rows without an id, which come last; rows that repeat an id and text share their
    result. Without rows there is no result row.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("i_"), F.xxhash64(text).alias("h_"), F.coalesce(F.col(text), F.lit("")).alias("t_"))
    short = F.length("t_") < max(1, least_chars)
    gone = repeated_lines(docs, scratch, doc_id, text, least_docs, least_chars)
    met = rows.where(~short).join(gone, F.col("i_").eqNullSafe(F.col("d")) & (F.col("h_") == F.col("th")), "left").select("row", "t_", "gone", _kept("t_", "gone").alias("kept"))
    every = met.union(rows.where(short).select("row", "t_", F.lit(None).cast("array<int>").alias("gone"), F.col("t_").alias("kept")))
    made = {"n_lines": F.length(F.col("t_")) - F.length(F.replace("t_", F.lit("\n"), F.lit(""))) + 1, "n_dropped": F.coalesce(F.size("gone"), F.lit(0)), "kept_text": F.col("kept")}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made]
    return every.select(*own, *[(c if n == "kept_text" else c.cast("long")).alias(n) for n, c in made.items()])
