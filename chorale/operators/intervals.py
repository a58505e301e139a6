"""Time grids, spans and interval joins.

An interval join equi-joins on its keys *and* on a time bucket, so a very long or very busy
recording is spread over as many tasks as it has buckets. Ordered work inside a recording
(previous row, merged spans, sliding counts) is cut into time blocks the same way, with a
second pass over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.params import MIN_OVERLAP_S
from chorale.session import spread

_FAR = 1e18


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def labels_window(ws: Column, we: Column, bs: Column, be: Column, floor_s: float = MIN_OVERLAP_S) -> Column:
    """The alignment rule: shared time, at least min(floor, box length)."""
    ov = overlap(ws, we, bs, be)
    return (ov > 0) & (ov >= F.least(F.lit(floor_s), be - bs) - 1e-9)


def any_overlap(ws: Column, we: Column, bs: Column, be: Column) -> Column:
    return (be > ws) & (bs < we)


def flat_overlap(ws: Column, we: Column, bs: Column, be: Column, floor_s: float = MIN_OVERLAP_S) -> Column:
    """A fixed floor: boxes shorter than it never match."""
    return overlap(ws, we, bs, be) >= floor_s


def either_overlap(ws: Column, we: Column, bs: Column, be: Column, floor_s: float = MIN_OVERLAP_S) -> Column:
    """The practice rule: the floor is capped by either interval's length."""
    ov = overlap(ws, we, bs, be)
    return (ov > 0) & (ov >= F.least(F.lit(floor_s), we - ws, be - bs) - 1e-9)


def with_buckets(df: DataFrame, bucket_s: float, start: str, end: str, name: str = "_bk") -> DataFrame:
    lo = F.floor(F.col(start) / bucket_s)
    return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, F.floor(F.col(end) / bucket_s)))))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], bucket_s: float, rule=labels_window) -> DataFrame:
    """Pairs whose [start_s, end_s) meet under ``rule``; the right side's times come out as b_start, b_end.

    A pair is kept only in the bucket where both have begun, so it appears once. The sides are merged, never sent whole to
    every task: windows are often made of a few recordings by an explode, which no size check sees.
    """
    r = right.withColumnRenamed("start_s", "b_start").withColumnRenamed("end_s", "b_end")
    lb = with_buckets(left, bucket_s, "start_s", "end_s")
    rb = with_buckets(r, bucket_s, "b_start", "b_end")
    both = lb.hint("merge").join(rb, [*on, "_bk"])
    first = F.floor(F.greatest("start_s", "b_start") / bucket_s) == F.col("_bk")
    return both.where(first & rule(F.col("start_s"), F.col("end_s"), F.col("b_start"), F.col("b_end"))).drop("_bk")


# ------------------------------------------------------------------ grids
def n_windows(duration: Column, window_s: float, hop_s: float) -> Column:
    """Whole windows only."""
    return F.greatest(F.lit(0), F.floor((duration - window_s) / hop_s) + 1)


def window_starts(recordings: DataFrame, window_s: float, hop_s: float) -> DataFrame:
    n = n_windows(F.col("duration_s"), window_s, hop_s)
    return recordings.where(n > 0).select(
        "recording_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(
        "recording_id", (F.col("i") * hop_s).cast("double").alias("start_s"),
        (F.col("i") * hop_s + window_s).cast("double").alias("end_s"))


def window_grid(spans: DataFrame, hop_s: float) -> DataFrame:
    """Window starts overlapping each [t0, t1) range, per range row."""
    first = F.floor(F.round(F.col("t0") / hop_s, 6))
    last = F.ceil((F.col("t1") - 1e-9) / hop_s) - 1
    return spans.where(last >= first).withColumn("i", F.explode(F.sequence(first, last))).withColumn(
        "start_s", F.round(F.col("i") * hop_s, 6)).drop("i")


def all_chunks(recordings: DataFrame, chunk_s: float = 60.0) -> DataFrame:
    """Sign-off chunks; a tail under one second is folded into the chunk before it."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("duration_s") - 1.0, F.lit(0.0)) / chunk_s))
    i = F.col("_i")
    return recordings.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "recording_id", (i * chunk_s).cast("double").alias("start_s"),
        F.when(i == F.col("_n") - 1, F.col("duration_s")).otherwise((i + 1) * chunk_s).cast("double").alias("end_s"),
        F.coalesce("site", F.lit("")).alias("site"), F.coalesce("start_time", F.lit("")).alias("start_time"))


def chunk_of(t: Column, chunk_s: float = 60.0) -> Column:
    return F.floor(F.greatest(t, F.lit(0.0)) / chunk_s) * chunk_s


def chunks_touched(df: DataFrame, chunk_s: float = 60.0, name: str = "chunk") -> DataFrame:
    """One row per chunk a box overlaps."""
    lo = F.floor(F.greatest(F.col("start_s"), F.lit(0.0)) / chunk_s)
    hi = F.floor(F.greatest(F.col("start_s"), F.col("end_s") - 1e-6) / chunk_s)
    return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi)))).withColumn(
        name, (F.col(name) * chunk_s).cast("double"))


def meeting(df: DataFrame, t0, t1, slack: float = 0.0) -> DataFrame:
    """Rows whose interval meets [t0, t1)."""
    return df.where((F.col("end_s") > F.lit(t0) + slack) & (F.col("start_s") < F.lit(t1) - slack))


# ------------------------------------------------------------------ ordered work in blocks
def with_previous(df: DataFrame, keys: list[str], cols: list[str], block_s: float, order: str = "start_s",
                  ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``prev_<col>`` from the previous row of the key in time order.

    Inside a block this is a lag; the first row of a block takes the last row of the nearest
    earlier block, found over one row per (key, block).
    """
    d = df.withColumn("_blk", F.floor(F.col(order) / block_s))
    seq = [F.col(order), *[F.col(c) for c in ties]]
    w = Window.partitionBy(*keys, "_blk").orderBy(*seq)
    inner = d.select("*", F.row_number().over(w).alias("_rn"), *[F.lag(c).over(w).alias(f"_p_{c}") for c in cols])
    last = d.groupBy(*keys, "_blk").agg(F.max_by(F.struct(*cols), F.struct(*seq)).alias("_last"))
    ww = Window.partitionBy(*keys).orderBy("_blk")
    carry = last.select(*keys, "_blk", F.lag("_last").over(ww).alias("_carry"))
    out = inner.join(carry, [*keys, "_blk"], "left")
    first = F.col("_rn") == 1
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.when(first, F.col(f"_carry.{c}")).otherwise(F.col(f"_p_{c}")))
    return out.drop("_blk", "_rn", "_carry", *[f"_p_{c}" for c in cols])


def with_reach(df: DataFrame, keys: list[str], block_s: float, order: str = "start_s", end: str = "end_s") -> DataFrame:
    """Add ``reach``: the latest end among earlier rows of the key (NULL for the first)."""
    d = df.withColumn("_blk", F.floor(F.col(order) / block_s))
    w = Window.partitionBy(*keys, "_blk").orderBy(order, end).rowsBetween(Window.unboundedPreceding, -1)
    far = d.groupBy(*keys, "_blk").agg(F.max(end).alias("_far"))
    ww = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = far.select(*keys, "_blk", F.max("_far").over(ww).alias("_carry"))
    return d.withColumn("_in", F.max(end).over(w)).join(carry, [*keys, "_blk"], "left").withColumn(
        "reach", F.greatest("_in", "_carry")).drop("_blk", "_in", "_carry")


def island_ids(df: DataFrame, keys: list[str], flag: str, block_s: float, order: str = "start_s",
               ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``island``: a running count of ``flag`` rows per key, in blocks."""
    d = df.withColumn("_blk", F.floor(F.col(order) / block_s))
    w = Window.partitionBy(*keys, "_blk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    per = d.groupBy(*keys, "_blk").agg(F.sum(F.col(flag).cast("long")).alias("_n"))
    ww = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, "_blk", F.coalesce(F.sum("_n").over(ww), F.lit(0)).alias("_before"))
    return d.withColumn("_in", F.sum(F.col(flag).cast("long")).over(w)).join(before, [*keys, "_blk"]).withColumn(
        "island", F.col("_in") + F.col("_before")).drop("_blk", "_in", "_before")


def merge_spans(chunks: DataFrame, keys: list[str], block_s: float, tol: float = 1e-6) -> DataFrame:
    """Touching or overlapping spans become one."""
    d = with_reach(chunks.select(*keys, "start_s", "end_s"), keys, block_s)
    new = F.col("reach").isNull() | (F.col("start_s") > F.col("reach") + tol)
    d = island_ids(d.withColumn("_new", new), keys, "_new", block_s, ties=("end_s",))
    return d.groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")


def union_length(df: DataFrame, keys: list[str], block_s: float) -> DataFrame:
    """Seconds covered by the union of intervals, per key."""
    d = with_reach(df.select(*keys, "start_s", "end_s"), keys, block_s)
    fresh = F.greatest(F.lit(0.0), F.col("end_s") - F.greatest(F.col("start_s"), F.coalesce("reach", "start_s")))
    return d.groupBy(*keys).agg(F.sum(fresh).alias("covered_s"))


#: Earlier than any row, and still a whole number of blocks of time.
LONG_AGO = -1e15


def last_span(df: DataFrame, spans: DataFrame, block_s: float) -> DataFrame:
    """Each row with ``_ce``, the end of its recording's last span (recording_id, _cs, _ce) that starts no later than it;
    NULL without one.

    A merge as-of: rows and span starts are one ordering within (recording, time block); the span in force where a block
    begins is carried over one row per block. So neither a long recording nor a long span is one task's."""
    row = F.struct(*[F.col(c) for c in df.columns])
    tagged = df.select("recording_id", F.col("start_s").alias("_t"), F.lit(1).alias("_tag"), row.alias("_row"), F.lit(None).cast("double").alias("_end")).unionByName(
        spans.select("recording_id", F.col("_cs").alias("_t"), F.lit(0).alias("_tag"), F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType).alias("_row"), F.col("_ce").alias("_end")))
    tagged = tagged.withColumn("_blk", F.floor(F.col("_t") / block_s))
    so_far = Window.partitionBy("recording_id", "_blk").orderBy("_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    seen = tagged.withColumn("_in", F.last("_end", ignorenulls=True).over(so_far))
    before = Window.partitionBy("recording_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tagged.groupBy("recording_id", "_blk").agg(F.max_by("_end", F.when(F.col("_tag") == 0, F.col("_t"))).alias("_last"))
    carried = blocks.select("recording_id", "_blk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = seen.where("_tag = 1").join(carried, ["recording_id", "_blk"])
    return out.select("_row.*", F.coalesce("_in", "_carry").alias("_ce"))


def within(df: DataFrame, coverage: DataFrame, block_s: float) -> DataFrame:
    """Rows lying wholly inside covered time: the last span to start before the row holds its end. Spans are disjoint."""
    spans = coverage.select("recording_id", F.col("start_s").alias("_cs"), F.col("end_s").alias("_ce"))
    return last_span(df, spans, block_s).where(F.col("end_s") <= F.col("_ce") + 1e-6).drop("_ce")


def open_ended(coverage: DataFrame, durations: DataFrame) -> DataFrame:
    """Coverage whose spans have no end where they reach the recording's."""
    known = durations.select("recording_id", "duration_s")
    reaches = F.coalesce(F.col("end_s") >= F.col("duration_s") - 1e-6, F.lit(False))
    return coverage.select("recording_id", "start_s", "end_s").join(known, "recording_id", "left").select(
        "recording_id", "start_s", F.when(reaches, F.lit(float("inf"))).otherwise(F.col("end_s")).alias("end_s"))


def within_or_last(df: DataFrame, coverage: DataFrame, durations: DataFrame, block_s: float) -> DataFrame:
    """``within``, where a span that reaches the recording's end also admits rows running past it."""
    return within(df, open_ended(coverage, durations), block_s)


def merge_runs(blocks: DataFrame, keys: list[str], block_s: float, tol: float = 1e-6) -> DataFrame:
    """Consecutive windows of the same species (no other species between) become one span with the top score.

    A run breaks when the previous row *of any species* differs, or at a gap. Inside an unbroken
    stretch of one species the open end is the stretch's latest end.
    """
    order = ("species_key", "end_s")
    d = with_previous(blocks, keys, ["species_key"], block_s, ties=order)
    change = ~F.coalesce(F.col("prev_species_key") == F.col("species_key"), F.lit(False))
    d = island_ids(d.withColumn("_chg", change), keys, "_chg", block_s, ties=order).withColumnRenamed(
        "island", "_stretch").drop("_chg", "prev_species_key")
    d = with_reach(d, [*keys, "_stretch"], block_s)
    new = F.col("reach").isNull() | (F.col("start_s") > F.col("reach") + tol)
    d = island_ids(d.withColumn("_new", new), [*keys, "_stretch"], "_new", block_s, ties=("end_s",))
    return d.groupBy(*keys, "_stretch", "island", "species_key").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.max("score_raw").alias("score_raw")).drop("_stretch", "island")


def score_runs(marks: DataFrame, keys: list[str], hop: Column, block_s: float) -> DataFrame:
    """Unbroken runs of a species' windows: a start gap above 1.5 hops opens a new run."""
    k = [*keys, "species_key"]
    d = with_previous(marks, k, ["start_s"], block_s)
    gap = F.coalesce(F.col("start_s") - F.col("prev_start_s") > hop * 1.5, F.lit(False))
    d = island_ids(d.withColumn("_gap", gap), k, "_gap", block_s)
    return d.withColumnRenamed("island", "run").withColumn(
        "center_s", (F.col("start_s") + F.col("end_s")) / 2).drop("_gap", "prev_start_s")


def run_reach(runs: DataFrame, keys: list[str], hop: Column) -> DataFrame:
    """One row per run with how far it could have heard: half a hop beyond each end."""
    return runs.groupBy(*keys, "species_key", "run").agg(
        (F.min("start_s") - F.first(hop) / 2).alias("start_s"), (F.max("end_s") + F.first(hop) / 2).alias("end_s"),
        F.count(F.lit(1)).alias("windows"))


def run_correct(reach: DataFrame, ann: DataFrame, bucket_s: float, keys: list[str]) -> DataFrame:
    """Whether a box of the run's species falls within its reach."""
    ids = [*keys, "species_key", "run"]
    hit = interval_join(reach, ann.select("recording_id", "start_s", "end_s", "species_key"),
                        ["recording_id", "species_key"], bucket_s, any_overlap)
    hit = hit.select(*ids).distinct().withColumn("correct", F.lit(True))
    return reach.join(hit, ids, "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def span_counts(df: DataFrame, keys: list[str], span_s: float, order: str = "start_s") -> DataFrame:
    """Add ``in_span``: rows of the key starting in [t, t + span), the row included.

    Rows are copied into the block before theirs as look-ahead, so a window frame never leaves
    its block and no key is ordered as a whole.
    """
    blk = F.floor(F.col(order) / span_s)
    d = df.withColumn("_own", blk).withColumn("_blk", F.explode(F.array(blk, blk - 1)))
    over = f"OVER (PARTITION BY {', '.join([*keys, '_blk'])} ORDER BY {order} RANGE BETWEEN"
    upto = F.expr(f"count(1) {over} CURRENT ROW AND {float(span_s)}D FOLLOWING)")
    edge = F.expr(f"count(1) {over} {float(span_s)}D FOLLOWING AND {float(span_s)}D FOLLOWING)")
    return d.withColumn("in_span", upto - edge).where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")


def pack_rows(blocks: DataFrame, lane: list[str], schema: str) -> DataFrame:
    """Greedy first-fit lanes for the blocks of one view (a view is a bounded stretch of one recording).

    Views are dealt over tasks whole and come in order, so a task walks its rows once; the lanes of the view that a batch
    ends in are carried to the next, and no view becomes a frame of its own."""
    names = [f.name for f in blocks.schema.fields]

    def place(batches):
        view, free_at = None, []
        for pdf in batches:
            rows = []
            for key, s, e in zip(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in lane]), pdf["start_s"].tolist(), pdf["end_s"].tolist()):
                if key != view:
                    view, free_at = key, []
                lane_no = next((i for i, t in enumerate(free_at) if s >= t - 1e-9), len(free_at))
                free_at[lane_no:lane_no + 1] = [e]
                rows.append(lane_no)
            yield pdf.assign(row=rows)

    return spread(blocks, *lane).sortWithinPartitions(*lane, F.asc_nulls_last("start_s"), F.asc_nulls_last("tie")).select(*names).mapInPandas(place, schema)


def compare_to_reference(mine: DataFrame, ref: DataFrame, bucket_s: float, floor_s: float = MIN_OVERLAP_S
                         ) -> tuple[DataFrame, DataFrame]:
    """(calls, extra): each reference box found / named differently / missed; own boxes matching none.

    Both carry ``box_id``. The other name is that of the earliest overlapping own box.
    """
    rule = lambda a, b, c, d: either_overlap(a, b, c, d, floor_s)
    own = mine.select("recording_id", "start_s", "end_s", F.col("species_key").alias("mine_key"),
                      F.col("box_id").alias("mine_id"))
    pairs = interval_join(ref, own, ["recording_id"], bucket_s, rule)
    same = F.col("mine_key") == F.col("species_key")
    best = pairs.groupBy("recording_id", "box_id").agg(
        F.max(same).alias("_same"),
        F.min_by("mine_key", F.when(~same, F.struct("b_start", "mine_id"))).alias("_other"))
    calls = ref.join(best, ["recording_id", "box_id"], "left").withColumn(
        "outcome", F.when(F.col("_same"), "found").when(F.col("_other").isNotNull(), "named differently")
        .otherwise("missed")).withColumn(
        "yours", F.when(F.col("_same"), F.col("species_key")).otherwise(F.col("_other"))).drop("_same", "_other")
    matched = pairs.where(same).select("recording_id", F.col("mine_id").alias("box_id")).distinct()
    return calls, mine.join(matched, ["recording_id", "box_id"], "left_anti")
