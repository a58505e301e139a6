"""Bootstrap intervals over recordings, single and paired.

Two ways to draw. Every (replicate, recording) gets an independent Poisson(1) weight from a hash:
no draw table, all replicates of a recording are drawn at once, and only (arm, replicate) sums are
shuffled. ``draws`` takes an explicit (rep, idx, w) table, for exact agreement with a given
generator where the number of recordings is small.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators.outcomes import false_events
from chorale.params import MIN_UNITS
from chorale.session import cut, spread

COUNTS = ("reported", "right", "positives", "songs_found", "songs", "false_events", "hours")
STATS = {"precision": ("right", "reported"), "window_recall": ("right", "positives"),
         "found": ("songs_found", "songs"), "false_per_hour": ("false_events", "hours")}
#: Cumulative Poisson(1) probabilities P(X <= 0), P(X <= 1), ..., up to what 52 bits of a hash can reach.
POISSON_1 = tuple(accumulate(exp(-1.0) / factorial(k) for k in range(18)))
#: Rows whose weights of all replicates a task holds at once.
DRAWN = 512


def per_recording(lab: DataFrame, boxes: DataFrame, hours: DataFrame, arm: list[str], block_s: float) -> DataFrame:
    """The additive counts behind every headline number, one row per (arm, recording)."""
    k = [*arm, "recording_id"]
    base = lab.groupBy(*k).agg(
        F.count_if("hit").alias("reported"), F.count_if(F.col("hit") & (F.col("y_true") == 1)).alias("right"),
        F.count_if(F.col("y_true") == 1).alias("positives"))
    songs = boxes.where("outcome <> 'not asked'").groupBy(*k).agg(
        F.count_if(F.col("outcome") == "found").alias("songs_found"), F.count(F.lit(1)).alias("songs"))
    fe = false_events(lab, arm, block_s).groupBy(*k).agg(F.sum("events").alias("false_events"))
    return base.join(songs, k, "left").join(fe, k, "left").join(hours, "recording_id", "left").fillna(
        0, ["songs_found", "songs", "false_events", "hours"]).select(*k, *[F.col(c).cast("double").alias(c) for c in COUNTS])


def ratios(prefix: str = "") -> dict[str, Column]:
    return {s: F.when(F.col(prefix + d) > 0, F.col(prefix + n) / F.col(prefix + d)) for s, (n, d) in STATS.items()}


def point(per_rec: DataFrame, arm: list[str]) -> DataFrame:
    return per_rec.groupBy(*arm).agg(*[F.sum(c).alias(c) for c in COUNTS]).select(*arm, *[c.alias(s) for s, c in ratios().items()])


def poisson_weights(seed: int, n: int, unit: str) -> np.ndarray:
    """Poisson(1) counts of one unit in replicates 0 to n - 1, which depend only on (seed, replicate, unit)."""
    drawn = b"".join(hashlib.md5(f"{seed}:{rep}:{unit}".encode()).digest()[:8] for rep in range(n))
    u = (np.frombuffer(drawn, ">u8") >> np.uint64(12)).astype(float) / 4503599627370496.0  # the first 52 bits of each
    return np.searchsorted(POISSON_1, u, side="left")


def replicate_sums(per_rec: DataFrame, arm: list[str], counts: list[str], n: int, seed: int,
                   draws: DataFrame | None = None, unit: str = "recording_id") -> DataFrame:
    """Resampled totals per (arm, rep). The same recordings are drawn for every arm.

    A task draws each unit's weights for all replicates at once and adds weights times counts up per arm; only its
    (arm, replicate) sums are shuffled, no row per draw. Units are dealt over all tasks, as each costs ``n`` hashes, and
    come in order, so that the arms of one share its weights; a task holds the weights of ``DRAWN`` rows."""
    if draws is not None:
        d = per_rec.join(draws, "idx")
        return d.groupBy(*arm, "rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in counts], F.sum("w").alias("units"))
    rows = per_rec.select(*arm, F.col(unit).cast("string").alias("unit_"), *[F.col(c).cast("double").alias(c) for c in counts])
    kinds = [f"`{k}` {t}" for k, t in rows.select(*arm).dtypes]
    shape = ", ".join([*kinds, "rep int", *[f"`{c}` double" for c in counts], "units long"])

    def added(batches):
        sums: dict = {}
        for pdf in (batch.iloc[lo:lo + DRAWN] for batch in batches for lo in range(0, len(batch), DRAWN)):
            drawn = {u: poisson_weights(seed, n, u) for u in pdf["unit_"].unique()}
            for key, part in pdf.groupby(arm, sort=False, dropna=False) if arm else [((), pdf)]:
                w = np.stack([drawn[u] for u in part["unit_"]])
                got = np.column_stack([w.T @ part[counts].fillna(0.0).to_numpy(float), w.sum(axis=0)])
                sums[key] = sums[key] + got if key in sums else got
            if len(sums) > 256:
                yield from said(sums)
                sums = {}
        yield from said(sums)

    def said(sums):
        for key, got in sums.items():
            out = pd.DataFrame(got[:, :-1], columns=counts)
            out.insert(0, "rep", np.arange(n, dtype=np.int32))
            for k, v in zip(reversed(arm), reversed(key)):
                out.insert(0, k, v)
            yield out.assign(units=got[:, -1].astype(np.int64))[lambda x: x["units"] > 0]

    return spread(rows, "unit_").sortWithinPartitions("unit_").mapInPandas(added, shape).groupBy(*arm, "rep").agg(*[F.sum(c).alias(c) for c in counts], F.sum("units").alias("units"))


def intervals(stats: DataFrame, arm: list[str], names: list[str], level: float = 0.95) -> DataFrame:
    """Percentile intervals over the replicates (one row each), long: (arm, stat, lo, hi)."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    if arm:
        q = stats.groupBy(*arm).agg(*[F.percentile(s, [lo, hi]).alias(s) for s in names])
    else:
        q = stats.agg(*[F.percentile(s, [lo, hi]).alias(s) for s in names])
    rows = F.array(*[F.struct(F.lit(s).alias("stat"), F.try_element_at(s, F.lit(1)).alias("lo"),
                              F.try_element_at(s, F.lit(2)).alias("hi")) for s in names])
    return q.select(*arm, F.explode(rows).alias("r")).select(*arm, "r.*")


def bootstrap(per_rec: DataFrame, arm: list[str], n: int = 1000, seed: int = 0, level: float = 0.95,
              draws: DataFrame | None = None, min_units: int = MIN_UNITS) -> DataFrame:
    """(arm, stat, value, lo, hi); no interval below ``min_units`` recordings."""
    per_rec = cut(per_rec)  # one row per arm and recording, read three times
    sums = replicate_sums(per_rec, arm, list(COUNTS), n, seed, draws)
    iv = intervals(sums.select(*arm, *[c.alias(s) for s, c in ratios().items()]), arm, list(STATS), level)
    units = per_rec.groupBy(*arm).agg(F.count(F.lit(1)).alias("_units"))
    pt = point(per_rec, arm).select(*arm, F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])).alias("p")).select(*arm, "p.*")
    enough = F.col("_units") >= min_units
    return pt.join(iv, [*arm, "stat"], "left").join(units, arm).select(
        *arm, "stat", "value", F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"))


def paired(a: DataFrame, b: DataFrame, n: int = 1000, seed: int = 0, level: float = 0.95,
           draws: DataFrame | None = None, min_units: int = MIN_UNITS) -> DataFrame:
    """a - b on the recordings both have, the same resample for both: (stat, diff, lo, hi, verdict)."""
    both = cut(a.select("recording_id", *[c for c in a.columns if c == "idx"], *[F.col(c).alias(f"a_{c}") for c in COUNTS]).join(
        b.select("recording_id", *[F.col(c).alias(f"b_{c}") for c in COUNTS]), "recording_id"))
    cols = [f"{p}_{c}" for p in "ab" for c in COUNTS]
    diff = {s: ratios("a_")[s] - ratios("b_")[s] for s in STATS}
    sums = replicate_sums(both, [], cols, n, seed, draws)
    iv = intervals(sums.select(*[c.alias(s) for s, c in diff.items()]), [], list(STATS), level)
    tot = both.agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_units"))
    pt = tot.select("_units", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), c.alias("diff")) for s, c in diff.items()])).alias("p")
                    ).select("_units", "p.*")
    enough = F.col("_units") >= min_units
    out = pt.join(iv, "stat").select("stat", "diff", F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"))
    return out.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def verdict(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull(), "too few recordings to say").when(lo > 0, "higher").when(hi < 0, "lower").otherwise(
        "no clear difference")


def width(iv: DataFrame) -> DataFrame:
    return iv.withColumn("width", F.col("hi") - F.col("lo"))
