"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order within its source, gets a virtual finish time: the source's cumulative tokens up to
and including it, over the source's target. Passes over a source that must be repeated go on counting. The documents of
all sources are then put in order of finish time and cut off at the total budget. Virtual time runs alike for all
sources, so equal slices of it hold about equal tokens: slices are the ranges of the global sort, and only the slice in
which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most passes over one source.
PASSES = 3
#: Rows meant for one slice of a source or of virtual time.
SLICE = 1_000
#: Slices summed together when the end of the budget is looked for.
COARSE = 1_000
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)

WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn. Together they get the sum of all sizes;
    none gets more than ``passes`` times its own size, and what it cannot take is shared out again by weight. In order
    of cap over weight the capped sources come first: the level that the others share is the first one that fits.
    This table is the configuration of a mix, a few numbers per source, and is worked on in one task.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * passes)
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("taken_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("all_w", F.sum("w").over(whole)).withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("taken_w")).cast("double"))
        .withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    )
    share = F.first("fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("share", share).select(
        "source", "source_size",
        F.when(F.col("share").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("share") * F.col("w"))).alias("target"))


def _running(df: DataFrame, keys: list[str], slice_col: str, order: list, size: str, out: str, slices: DataFrame | None = None) -> DataFrame:
    """Running sum of ``size`` within ``keys`` in order (slice, order): slices are summed first, rows only inside theirs."""
    sums = slices if slices is not None else df.groupBy(*keys, slice_col).agg(F.sum(size).alias("slice_size"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col(slice_col).alias("s_slice"), "offset")
    on = F.col(slice_col) == F.col("s_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("inside", F.sum(size).over(inside)).join(sums, on).withColumn(out, F.col("offset") + F.col("inside")).drop(
        *[f"s_{k}" for k in keys], "s_slice", "offset", "inside")


def mix(docs: DataFrame, scratch, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row per document: words the mix takes of it, repeats counted.

    Null and empty texts have size 0 and are taken as 0 words; a null source is a source; null ids are documents like
    others. Order within a source is by md5 of seed and id, so reruns agree; equal rows may swap places, which shows in
    no result. An empty table gives an empty one. Other columns are not read.
    """
    rows = scratch.cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
                       .withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes)
    goals = scratch.cut(goals.select(F.col("source").alias("g_source"), "source_size", "target"))
    n = max(1, rows.count() // SLICE)
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(2 ** 32)).cast("long"))
    rows = _running(rows, ["source"], "slice", ["h", F.col("doc_id")], "size", "cum")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source", "slice")
    rows = scratch.cut(rows)

    goes = (F.col("size") > 0) & (F.col("target") > 0)
    turns = rows.where(goes).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    turns = turns.withColumn("finish", _finish(F.col("turn"))).withColumn("slice", F.floor(F.col("finish") * n).cast("long"))
    budget = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()["budget"]
    # where the budget ends: among thousands of slices, then among slices, then among the documents of one slice
    per = scratch.cut(turns.groupBy("slice").agg(F.sum("size").alias("x")).withColumn("coarse", F.floor(F.col("slice") / COARSE)))
    coarse, spent = _edge(per.groupBy("coarse").agg(F.sum("x").alias("x")), ["coarse"], 0, budget)
    if coarse is None:
        limit = None
    else:
        fine, spent = _edge(per.where(F.col("coarse") == coarse["coarse"]), ["slice"], spent, budget)
        limit, _ = _edge(turns.where(F.col("slice") == fine["slice"]).withColumn("x", F.col("size")), ["finish", "h", "turn"], spent, budget)
    passed = F.lit(0)
    for t in range(passes):
        at = F.struct(_finish(F.lit(t)).alias("finish"), F.col("h").alias("h"), F.lit(t).alias("turn"))
        ends = F.struct(F.lit(limit["finish"]).alias("finish"), F.lit(limit["h"]).alias("h"), F.lit(limit["turn"]).alias("turn")) if limit else None
        passed = passed + ((at < ends).cast("int") if limit else F.lit(1))
    taken = F.when(goes, F.col("size") * passed).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _finish(turn) -> F.Column:
    return (turn * F.col("source_size") + F.col("cum")) / F.col("target")


def _edge(df: DataFrame, order: list[str], spent: int, budget: int):
    """The first row in order whose running sum of x passes the budget, and the sum before it; (None, sum) if none does."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    row = df.withColumn("upto", F.sum("x").over(upto) + spent).where(F.col("upto") > budget).orderBy(*order).select(*order, "x", "upto").first()
    return (row, row["upto"] - row["x"]) if row else (None, spent)
