"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets are one entity. In each of ``trees`` independent trees entities branch by one minwise
token after the other; a node of at most ``small`` entities is compared exhaustively, a larger one branches on, so that
unlike documents part while like ones stay together. A pair of similarity s shares a node of depth d in none of the trees
with probability (1 - s^d)^trees, so trees end at the last depth where that is ``1 - RECALL`` at most.

A dense group keeps its nodes large. There the entity nearest to the node's centroid is compared with all others, and
what it links is one component from then on; afterwards only pairs of different components are compared, so that a group
of n copies costs about n comparisons. Entities whose nodes are still large where their trees end meet by a prefix filter
besides: with all shingles in one order, rarest first, two sets as alike as asked share one of the first few of each. That
way misses no pair; it costs the square of a family whose members share nearly as much as asked, and yet are not linked.

Before texts are fetched, pairs are dropped that differ in more bits of a parity sketch than sets as alike as asked can
(each shingle in only one of two sets turns one bit, so the test never drops a link, and for sets of up to some hundred
shingles it leaves hardly anything else), or that agree on too few of 128 minwise tokens (by over five standard deviations
at the threshold). Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.components import components
from chorale.llm.shingles import WordHashes, common, shingle_set, slices
from chorale.llm.store import Scratch

FUNCTIONS = 128
TREES = 16
#: Trees whose small nodes are compared before those of the others.
FIRST_TREES = 2
#: Entities of a node that are compared exhaustively.
SMALL = 64
#: Tokens of a path at each level of a tree; 16 trees of 8 tokens use each function once, so that trees are independent.
LEVELS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Least probability that a pair at the threshold shares a node where the trees end.
RECALL = 0.99
#: Counters by which shingles are ordered. Any order is right; what shares a counter only counts as more frequent.
CELLS = 1 << 18
#: Shingles that are hashed at once.
CHUNK = 4096
#: Entities whose tokens differ from a centroid's by less are equally near to it; each node chooses among them anew.
NEAR = 3
SKETCH = ("s1", "s2", "s3", "s4")
#: Words of the parity sketch, 64 bits each.
PARITY = tuple(f"o{i}" for i in range(16))


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 2 ** 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, th, n, fp, mins, s1..s4, o0..o15): set size, fingerprint of the set, minwise tokens, two bits of each
    packed, and for each of 1024 cells of a hash whether the set has an odd number of shingles there."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def job(batches):
        memo, mult = WordHashes(), _multipliers()
        mix, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(62)
        shift = (2 * np.arange(32)).astype(np.uint64)
        for b in slices(batches):
            n, fp, mins, bits, odd = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, memo, size)
                n.append(len(s))
                if not len(s):
                    fp.append(None)
                    mins.append(None)
                    bits.append((None,) * 4)
                    odd.append((None,) * len(PARITY))
                    continue
                cells = np.bincount(((s * mix) >> np.uint64(54)).astype(np.int64), minlength=64 * len(PARITY)) & 1
                odd.append(np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64).tolist())
                fp.append(hashlib.md5(s.tobytes()).digest())
                low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), CHUNK):
                    np.minimum(low, (s[i:i + CHUNK, None] * mult).min(axis=0), out=low)
                low *= mix
                mins.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
                two = ((low * mix) >> top).reshape(4, 32) << shift
                bits.append(tuple(int(x) for x in np.bitwise_or.reduce(two, axis=1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(mins, pa.list_(pa.int32())),
                 *[pa.array([x[i] for x in bits], pa.int64()) for i in range(4)], *[pa.array([x[i] for x in odd], pa.int64()) for i in range(len(PARITY))]],
                names=["doc_id", "th", "n", "fp", "mins", *SKETCH, *PARITY])

    return rows.mapInArrow(job, "doc_id long, th long, n long, fp binary, mins array<int>, " + ", ".join(f"{c} long" for c in (*SKETCH, *PARITY)))


def _differ(a: str, b: str) -> F.Column:
    """Number of minwise tokens whose two bits differ."""
    out = F.lit(0)
    for s in SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def _most_differ(percent: int) -> int:
    p = 0.75 * (1 - percent / 100)
    return int(FUNCTIONS * p + 5.2 * (FUNCTIONS * p * (1 - p)) ** 0.5) + 1


def _path(tokens: int) -> F.Column:
    """Key of the node that an entity reaches in tree ``t`` after so many tokens; trees choose different functions."""
    at = lambda i: F.get("mins", F.col("t") + TREES * i)
    return F.xxhash64(F.col("t"), F.lit(tokens), *[at(i) for i in range(tokens)])


def _levels(percent: int) -> tuple[int, ...]:
    return tuple(d for d in LEVELS if 1 - (1 - (percent / 100) ** d) ** TREES >= RECALL)


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (key, t, fp) of nodes with two entities at least, with the node's size."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "key")


def _hubs(large: DataFrame, sketches: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(fp, hub, far): each entity of a large node with the node's entity nearest to its centroid, if sizes and tokens agree
    enough. An entity is in large nodes of many trees, so parity sketches wait until each pair is there once.

    The centroid is the bitwise majority of 32 members, one for each value of a salt, picked by partial aggregation."""
    rows = scratch.cut(large.select("key", "fp").join(sketches.select("fp", "n", *SKETCH), "fp"))
    sample = rows.groupBy("key", F.pmod(F.xxhash64("fp"), F.lit(32)).alias("salt")).agg(F.min(F.struct(F.xxhash64("fp", F.lit(3)).alias("h"), *SKETCH)).alias("x"))
    sample = sample.groupBy("key").agg(F.collect_list("x").alias("xs"))

    def majority(batches):
        for b in batches:
            out = []
            for xs in b.column(1).to_pylist():
                bits = np.unpackbits(np.array([[x[s] for s in SKETCH] for x in xs], np.int64).view(np.uint8), axis=1, bitorder="little")
                out.append(np.packbits(bits.sum(axis=0) * 2 > len(xs), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([int(x[i]) for x in out], pa.int64()) for i in range(4)]], names=["key", *SKETCH])

    centre = scratch.cut(sample.mapInArrow(majority, "key long, s1 long, s2 long, s3 long, s4 long"))
    near = rows.alias("r").join(centre.alias("c"), F.col("r.key") == F.col("c.key")).groupBy("r.key").agg(
        F.min(F.struct(F.floor(_differ("r", "c") / NEAR).alias("d"), F.xxhash64("r.fp", "r.key").alias("o"), *[F.col(f"r.{c}").alias(c) for c in ("fp", "n", *SKETCH)])).alias("x"))
    near = scratch.cut(near.select("key", "x.*").drop("d", "o"))
    return rows.alias("a").join(near.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & _agrees(percent)).select(
        F.col("a.fp").alias("fp"), F.col("b.fp").alias("hub"), _differ("a", "b").alias("far"))


def _merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, label) of all entities linked so far: components of the links between labels, so that a round costs its own links."""
    if labels is None:
        return components(links, scratch).withColumnsRenamed({"node": "fp", "root": "label"})
    for end in "ab":
        links = links.join(labels.withColumnsRenamed({"fp": end, "label": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    roots = components(links, scratch)
    moved = labels.join(roots, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels.select(F.col("fp").alias("node")), "node", "left_anti").select(F.col("node").alias("fp"), F.col("root").alias("label"))
    return scratch.cut(moved.union(new))


def _agrees(percent: int) -> F.Column:
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return sizes & (_differ("a", "b") <= _most_differ(percent))


def _parity(percent: int) -> F.Column:
    turned = F.lit(0)
    for o in PARITY:
        turned = turned + F.bit_count(F.col(f"a.{o}").bitwiseXOR(F.col(f"b.{o}")))
    # of sets with 100 * intersection >= percent * union at most this part of all members is in one set only
    return turned * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _fits(percent: int) -> F.Column:
    return _agrees(percent) & _parity(percent)


def _exhaustive(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different labels within a node that agree enough. Nodes (key, size, fp, label, n and sketches) of more
    than ``SMALL`` entities are dealt to blocks, and each pair of blocks is one cell of work."""
    blocks = F.ceil(F.col("size") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(11)), blocks).cast("int")
    rows = nodes.withColumns({"blocks": blocks, "own": own})
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rows.withColumn("other", F.explode(F.filter(every, lambda x: x >= F.col("own")))).withColumns({"u": F.col("own"), "v": F.col("other")})
    right = rows.withColumn("other", F.explode(F.filter(every, lambda x: x <= F.col("own")))).withColumns({"u": F.col("other"), "v": F.col("own")})
    ordered = (F.col("a.u") != F.col("a.v")) | (F.col("a.fp") < F.col("b.fp"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v"))
    return left.alias("a").join(right.alias("b"), on & ordered & (F.col("a.label") != F.col("b.label")) & _fits(percent)).select(
        F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))


def _place(doc_id: str, th: str) -> F.Column:
    """Where a text is found: its hash and its row's id, as one key."""
    return F.concat_ws(":", F.col(th).cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def _stored_texts(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    """(at, text) of all texts, shuffled once; every check finds texts there by joins that do not move them again."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("text is not null")
    return scratch.dealt(rows.select(_place("doc_id", "th").alias("at"), "text"), "at")


def _texts(wanted: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, text): one text of each entity in ``wanted`` (fp)."""
    return wanted.join(entities.select("fp", "at"), "fp").join(texts, "at").select("fp", "text")


def _rarest(texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(key, fp, room): of each set of n shingles the n + 1 - ceil(n * percent / 100) rarest ones. Sets as alike as ``percent``
    have as many shingles in common that they share one of these. ``room``: the shingle itself and those after it in order,
    which is the most that the set can share with one whose first shingle in common it is."""

    def count(batches):
        memo, seen = WordHashes(), np.zeros(CELLS, np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                np.add.at(seen, shingle_set(t, memo, size) % np.uint64(CELLS), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["cell", "n"])

    sums = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    often = np.zeros(CELLS, np.int64)
    often[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    often = np.minimum(often, np.iinfo(np.int32).max).astype(np.int32)

    def pick(batches):
        memo = WordHashes()
        for b in slices(batches):
            fps, keys, room = [], [], []
            for fp, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(t, memo, size)
                first = np.lexsort((s, often[s % np.uint64(CELLS)]))[:len(s) + 1 - -(-len(s) * percent // 100)]
                fps += [fp] * len(first)
                keys.append(s[first].view(np.int64))
                room.append(len(s) - np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, room)], pa.array(fps, pa.binary())], names=["key", "room", "fp"])

    return texts.select("fp", "text").mapInArrow(pick, "key long, room long, fp binary")


def _within_room(first: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows of ``first`` (key, room, n, label and others) that can be the first shingle in common of two sets as alike as
    ``percent`` and of different labels, with the ``size`` of what is left of their key.

    Such sets of n and m shingles share percent * (n + m) / (100 + percent) of them at least, and at most the room of either,
    so a row only meets sets of up to a certain size, and may go if its key holds none of another label so small, or that leaves
    it so much room. A member of a large family whose own shingles, which are the rarest, take all that its room would have
    to hold is so compared with none of it."""
    most = (F.col("room") * (100 + percent)).cast("double") / percent - F.col("n")
    rows = first.withColumn("most", F.floor(most + 1e-6)).where(F.col("most") * 100 >= F.col("n") * percent)
    for _ in range(2):
        by = rows.groupBy("key", "label").agg(F.min("n").alias("n"), F.max("most").alias("most"), F.count(F.lit(1)).alias("c"))
        # the least size, and the greatest room, of the label that has it and of all others
        two = lambda c, up: F.max_by("label", c) if up else F.min_by("label", c)
        tops = by.groupBy("key").agg(two("n", False).alias("small"), two("most", True).alias("wide"), F.min("n").alias("n1"), F.max("most").alias("m1"))
        others = by.join(tops, "key").groupBy("key").agg(
            F.first("small").alias("small"), F.first("wide").alias("wide"), F.first("n1").alias("n1"), F.first("m1").alias("m1"),
            F.min(F.when(F.col("label") != F.col("small"), F.col("n"))).alias("n2"), F.max(F.when(F.col("label") != F.col("wide"), F.col("most"))).alias("m2"))
        least, widest = F.when(F.col("label") == F.col("small"), F.col("n2")).otherwise(F.col("n1")), F.when(F.col("label") == F.col("wide"), F.col("m2")).otherwise(F.col("m1"))
        rows = scratch.cut(rows.join(others, "key").where((F.col("most") >= least) & (widest >= F.col("n"))).select(*first.columns, "most"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "key").drop("most", "room")


def _confirmed(pairs: DataFrame, entities: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    at = lambda c: entities.select(F.col("fp").alias(c), F.col("at").alias(f"{c}_at"))
    text = lambda c: texts.select(F.col("at").alias(f"{c}_at"), F.col("text").alias(f"t{c}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").join(text("a"), "a_at").join(text("b"), "b_at").select("a", "b", "ta", "tb")

    def job(batches):
        memo, kept = WordHashes(), (None, None)
        for batch in slices(batches):
            good = []
            for ta, b, tb in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if kept[0] != b:
                    kept = (b, shingle_set(tb, memo, size))
                x = shingle_set(ta, memo, size)
                both = common(x, kept[1])
                good.append(100 * both >= percent * (len(x) + len(kept[1]) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(job, "a binary, b binary")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept, class): a row per document. Documents are linked if
    100 * |intersection| >= percent * |union| of their sets of ``size``-word shingles; components are all that links reach.

    ``component_id`` is the smallest doc_id of the component, ``kept`` whether it is the row's own; ``class`` tells
    components apart where ids are null. Null and empty texts are linked with nothing and kept. Rows that repeat an id
    share its fate; a null id is larger than all others. ``th`` is a hash of the text. Other columns are not read.
    """
    seen = scratch.cut(describe(docs, doc_id, text, size))
    full = seen.where("fp is not null")
    entities = scratch.cut(full.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("one")).withColumn("at", _place("one.doc_id", "one.th")))
    reps = full.join(entities, "fp").where((F.col("th") == F.col("one.th")) & F.col("doc_id").eqNullSafe(F.col("one.doc_id")))
    reps = scratch.cut(reps.select("fp", "n", "mins", *SKETCH, *PARITY).dropDuplicates(["fp"]))
    sketches = reps.select("fp", "n", *SKETCH, *PARITY)

    rows = reps.select("fp", "mins", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).select("fp", "t", _path(1).alias("key"))
    levels = _levels(percent)
    nodes, hubs, dense = None, None, None if levels else reps.select("fp")
    for i, level in enumerate(levels):
        sized = scratch.cut(_sized(rows))
        done = sized.where(F.col("size") <= SMALL)
        nodes = done if nodes is None else nodes.union(done)
        large = sized.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        found = _hubs(large, sketches, percent, scratch)
        hubs = found if hubs is None else hubs.union(found)
        if i + 1 == len(levels):
            dense = large.select("fp").distinct()
        else:
            rows = large.select("fp", "t").join(reps.select("fp", "mins"), "fp").select("fp", "t", _path(levels[i + 1]).alias("key"))

    texts = _stored_texts(docs, scratch, doc_id, text)
    check = lambda p: scratch.cut(_confirmed(scratch.cut(p.distinct()), entities, texts, percent, size))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    labels = None
    if hubs is not None:
        met = hubs.groupBy("fp", "hub").agg(F.min("far").alias("far"))
        marks = sketches.select("fp", "n", *PARITY)
        met = met.alias("p").join(marks.alias("a"), F.col("p.fp") == F.col("a.fp")).join(marks.alias("b"), F.col("p.hub") == F.col("b.fp"))
        hubs = scratch.cut(met.where(_parity(percent)).select("p.fp", "hub", "far"))
    least = F.min(F.struct("far", F.xxhash64("fp", "hub").alias("o"), "fp", "hub")).alias("x")

    def labelled():
        return scratch.cut(sketches.withColumn("label", F.col("fp")) if labels is None else sketches.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))

    def apart():
        of = lambda c: labels.withColumnsRenamed({"fp": c, "label": f"{c}_label"})
        return hubs.join(of("fp"), "fp", "left").join(of("hub"), "hub", "left").withColumns({"u": F.coalesce("fp_label", "fp"), "v": F.coalesce("hub_label", "hub")}).where("u <> v")

    # each entity meets the nearest of its hubs; then each two labels meet once, and the first trees link most of what else
    # is alike; so the last round, hubs and the other trees, only compares what is still apart
    if hubs is not None:
        labels = _merged(None, check(hubs.groupBy("fp").agg(least).select(*pair("x.fp", "x.hub"))), scratch)
    for first in (True, False) if nodes is not None else ():
        found = _exhaustive(nodes.where((F.col("t") < FIRST_TREES) == first).select("key", "size", "fp").join(labelled(), "fp"), percent)
        if hubs is not None:
            rest = apart()
            found = found.union(rest.groupBy(F.least("u", "v"), F.greatest("u", "v")).agg(least).select(*pair("x.fp", "x.hub")) if first else rest.select(*pair("fp", "hub")))
        labels = _merged(labels, check(found), scratch)
    if dense is not None:
        first = scratch.cut(_rarest(scratch.cut(_texts(dense, entities, texts)), percent, size).join(labelled(), "fp"))
        # a shingle of one component only, such as those of a group of copies, yields no pair
        mixed = first.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        labels = _merged(labels, check(_exhaustive(_within_room(first.join(mixed, "key"), percent, scratch), percent)), scratch)

    named = entities.select("fp", "first_id").join(labels, "fp", "left").withColumn("class", F.coalesce("label", "fp")).drop("label")
    firsts = named.groupBy("class").agg(F.min("first_id").alias("component_id"))
    named = scratch.cut(named.join(firsts, "class").select("fp", "class", "component_id"))
    part = full.select("doc_id", "th", "n", "fp").join(named, "fp").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class")
    alone = seen.where("fp is null").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("class"))
    return part.union(alone)
