"""The stored index against the score matrices it was made from: rows, window rates and impostor masses side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators.index import WIN

ROW = ["species_key", "score_raw", "rank_in_window"]
PER = ["run_id", "recording_id"]


def row_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Per (run, recording): ``index_rows``, and rows that only one side has (``only_index``, ``only_matrix``).

    A signed count per distinct row, so repeated rows count as often as they occur, and what agrees cancels before
    anything is joined. Scores must agree to the bit."""
    key = [*WIN, *ROW]
    side = lambda df, sign: df.select(*key, F.lit(sign).alias("sign"))
    net = side(stored, 1).union(side(rebuilt, -1)).groupBy(*key).agg(
        F.sum("sign").alias("net"), F.count_if(F.col("sign") > 0).alias("held"))
    return net.groupBy(*PER).agg(
        F.sum("held").alias("index_rows"), F.sum(F.greatest("net", F.lit(0))).alias("only_index"),
        F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_matrix"))


def _summed(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, s: a + s.cast("double"))


def window_masses(score_windows: DataFrame, vocab: list[str], implausible: list[str], theta: float) -> DataFrame:
    """Per window the score at or over ``theta`` of all classes, and of implausible ones; nothing is exploded."""
    bad = F.array(*[F.lit(v in set(implausible)) for v in vocab])
    hit = lambda s: s.cast("double") >= theta
    return score_windows.select(
        *WIN, _summed(F.filter("scores", hit)).alias("total"),
        _summed(F.filter("scores", lambda s, i: hit(s) & F.element_at(bad, i + 1))).alias("bad"))


def index_masses(det: DataFrame, implausible: list[str], theta: float) -> DataFrame:
    """The same from the index."""
    score = F.col("score_raw").cast("double")
    return det.where(score >= theta).groupBy(*WIN).agg(
        F.sum(score).alias("total"), F.sum(F.when(F.col("species_key").isin(*implausible), score).otherwise(0.0)).alias("bad"))


def mass_differences(index: DataFrame, matrix: DataFrame) -> DataFrame:
    """Per (run, recording): windows with a hit and muddy windows on both sides, windows that only one side calls a hit, and
    the largest gap between the masses of a window. A window is met in one grouping of both sides."""
    side = lambda df, s: df.select(*WIN, *[F.col(c).alias(f"{c}_{s}") if s == t else F.lit(0.0).alias(f"{c}_{t}")
                                           for t in ("index", "matrix") for c in ("total", "bad")])
    sums = side(index, "index").unionByName(side(matrix, "matrix")).groupBy(*WIN).agg(
        *[F.sum(f"{c}_{t}").alias(f"{c}_{t}") for t in ("index", "matrix") for c in ("total", "bad")])
    share = lambda t: F.when(F.col(f"total_{t}") > 0, F.col(f"bad_{t}") / F.col(f"total_{t}")).otherwise(0.0)
    return sums.groupBy(*PER).agg(
        *[F.count_if(F.col(f"total_{t}") > 0).alias(f"windows_{t}") for t in ("index", "matrix")],
        *[F.count_if(F.col(f"bad_{t}") > 0).alias(f"muddy_{t}") for t in ("index", "matrix")],
        F.count_if((F.col("total_index") > 0) != (F.col("total_matrix") > 0)).alias("windows_apart"),
        F.max(F.abs(share("index") - share("matrix"))).alias("mass_gap"))


def cross_check(stored: DataFrame, rebuilt: DataFrame, score_windows: DataFrame, vocab: list[str], implausible: list[str],
                theta: float, tolerance: float = 1e-6) -> DataFrame:
    """One row per (run, recording) of either side, with ``agrees``: same rows, same windows, masses within ``tolerance``."""
    both = row_differences(stored, rebuilt).join(
        mass_differences(index_masses(stored, implausible, theta), window_masses(score_windows, vocab, implausible, theta)),
        PER, "full")
    numbers = [c for c in both.columns if c not in PER]
    full = both.fillna(0, numbers)
    same = ((F.col("only_index") + F.col("only_matrix") + F.col("windows_apart") == 0) & (F.col("muddy_index") == F.col("muddy_matrix"))
            & (F.col("mass_gap") < tolerance))
    return full.withColumn("agrees", same)
