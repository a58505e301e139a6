"""Ordered cumulative work without one task per key.

A window ordered over a whole key (one species, one run) puts that key in one task. Here the
order is cut into bins that depend only on the value: rows are summed inside (key, bin), the
bin totals (a few thousand rows per key at most) give each bin its offset, and the two are
added. Scores are float32, so a logarithmic bin holds a bounded number of distinct scores
whatever the data; after ties are collapsed that bounds the rows of every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_BINS = 1024  # per e-fold: at most 2**24 / 1024 distinct float32 values share a bin


def score_bin(x: Column) -> Column:
    """A bin that never decreases as the score rises; zero has a bin of its own."""
    v = x.cast("double")
    return F.when(v <= 0, F.lit(-(1 << 30)).cast("long")).otherwise(F.floor(F.ln(v) * LOG_BINS))


def linear_bin(x: Column, per_unit: int = 65536) -> Column:
    return F.floor(x.cast("double") * per_unit)


def running_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], descending: bool = True,
                   bin_of=score_bin, frame_end: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative sums in value order per key, plus the key's total of each as ``total_<name>``.

    ``df`` holds one row per (keys, value): collapse ties first. ``sums`` maps the output column to
    the summed one. ``frame_end=-1`` leaves the row itself out.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inner = Window.partitionBy(*keys, "_bin").orderBy(direction(value), *ties).rowsBetween(
        Window.unboundedPreceding, frame_end)
    outer = Window.partitionBy(*keys).orderBy(direction("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    binned = df.select("*", bin_of(F.col(value)).alias("_bin"))
    offsets = binned.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]).select(
        *keys, "_bin", *[F.coalesce(F.sum(f"_t_{o}").over(outer), zero).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"total_{o}") for o in sums])
    inside = binned.select("*", *[F.coalesce(F.sum(c).over(inner), zero).alias(f"_i_{o}") for o, c in sums.items()])
    return inside.join(offsets, [*keys, "_bin"]).select(
        *df.columns, *[(F.col(f"_i_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums], *[f"total_{o}" for o in sums])


def positions(df: DataFrame, keys: list[str], value: str, descending: bool = True, bin_of=score_bin) -> DataFrame:
    """Tie-collapsed values with ``n`` (rows of that value), ``upto`` (rows at or before it) and ``total``."""
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(ties, keys, value, {"upto": "n"}, descending, bin_of).withColumnRenamed(
        "total_upto", "total")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], bin_of=linear_bin
                    ) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size; NULL values are left out."""
    pos = positions(df.where(F.col(value).isNotNull()), keys, value, descending=False, bin_of=bin_of)
    aggs, finals = [], []
    for name, q in qs.items():
        at = (F.col("total") - 1) * F.lit(q)
        aggs += [F.min(F.when(F.col("upto") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("upto") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
                 F.max(at - F.floor(at)).alias(f"_f_{name}")]
        lo, hi, f = (F.col(f"_{p}_{name}").cast("double") for p in ("lo", "hi", "f"))
        finals.append((lo + (hi - lo) * f).alias(name))
    return pos.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def kth_largest(df: DataFrame, keys: list[str], value: str, k: Column) -> DataFrame:
    """The k-th largest value per key; the smallest when k passes the end. ``k`` may use the keys."""
    pos = positions(df, keys, value)
    want = F.least(F.greatest(k, F.lit(1)), F.col("total"))
    return pos.where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)).select(
        *keys, F.col(value).cast("double").alias("theta"), F.col("total"))


def thin(curve: DataFrame, keys: list[str], theta: str = "theta", n: int = 400) -> DataFrame:
    """About ``n`` evenly spaced rows per key, both ends kept (positions floor(i*(len-1)/(n-1)))."""
    ranked = running_totals(curve.withColumn("_one", F.lit(1)), keys, theta, {"_rank": "_one"})
    i, last = F.col("_rank") - 1, F.col("total__rank") - 1
    # row i is kept iff some j in 0..n-1 has floor(j*last/(n-1)) = i
    j = F.ceil(i * (n - 1) / last)
    keep = (F.col("total__rank") <= n) | ((j <= n - 1) & (F.floor(j * last / (n - 1)) == i))
    return ranked.where(keep).drop("_one", "_rank", "total__rank")
