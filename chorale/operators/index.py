"""Score matrices to the detections index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.params import ALWAYS_MIN_SCORE, INDEX_FLOOR, MIN_SCORE, TOP_K

WIN = ["run_id", "recording_id", "start_s"]


def explode_scores(score_windows: DataFrame, vocab: list[str]) -> DataFrame:
    """(window, class_idx, species_key, score) for every class of every window."""
    names = F.array(*[F.lit(v) for v in vocab])
    return score_windows.select("run_id", "recording_id", "start_s", "end_s",
                                F.posexplode("scores").alias("class_idx", "score")).withColumn(
        "species_key", F.element_at(names, F.col("class_idx") + 1))


def derive_detections(score_windows: DataFrame, vocab: list[str], top_k: int = TOP_K, min_score: float = MIN_SCORE,
                      always_keys: list[str] = (), always_min: float = ALWAYS_MIN_SCORE) -> DataFrame:
    """Keep top-k, or score >= floor, or a rescued species >= its own floor; ranks are over *all* classes.

    Ranking happens inside each row's array, so nothing is shuffled: the index is a map-only job.
    """
    names = F.array(*[F.lit(v) for v in vocab])
    rescued = F.array(*[F.lit(v) for v in always_keys]).cast("array<string>")
    entries = F.transform("scores", lambda s, i: F.struct((-s).alias("neg"), i.alias("class_idx")))
    ranked = F.transform(F.array_sort(entries), lambda e, i: F.struct(
        (-e["neg"]).alias("score"), F.element_at(names, e["class_idx"] + 1).alias("species_key"),
        (i + 1).alias("rank")))
    keep_all = top_k <= 0 or top_k >= len(vocab)
    kept = F.filter(ranked, lambda e: (F.lit(keep_all) | (e["rank"] <= top_k)
                                       | (e["score"].cast("double") >= min_score)
                                       | (F.array_contains(rescued, e["species_key"])
                                          & (e["score"].cast("double") >= always_min))))
    return score_windows.select("run_id", "recording_id", "start_s", "end_s", F.explode(kept).alias("e")).select(
        "recording_id", "run_id", "start_s", "end_s", F.col("e.species_key").alias("species_key"),
        F.col("e.score").alias("score_raw"), F.lit(None).cast("float").alias("occ_score"),
        F.lit(False).alias("suppressed"), F.col("e.rank").cast("int").alias("rank_in_window"))


def index_floor(score_transform_token: str) -> float:
    """The index floor of a readout; above 1 means ranks only."""
    return INDEX_FLOOR.get(score_transform_token, MIN_SCORE)


def rank_windows(scored: DataFrame) -> DataFrame:
    """Long scores in the DETECTIONS shape; a window holds at most one row per class."""
    w = Window.partitionBy(*WIN).orderBy(F.col("score").desc(), "species_key")
    return scored.select(
        "recording_id", "run_id", "start_s", "end_s", "species_key", F.col("score").alias("score_raw"),
        F.lit(None).cast("float").alias("occ_score"), F.lit(False).alias("suppressed"),
        F.row_number().over(w).alias("rank_in_window"))


def always_keys(profile: DataFrame, ann: DataFrame, max_tier: int = 2) -> DataFrame:
    """The rescue set: plausible species and annotated ones."""
    return profile.where(F.coalesce("tier", F.lit(3)) <= max_tier).select("species_key").union(
        ann.select("species_key")).distinct()


def apply_occurrence(det: DataFrame, occ: DataFrame, on: list[str], cutoff: float) -> DataFrame:
    """Fill occ_score and suppressed from an occurrence map; unknown occurrence never suppresses.

    The map is as small as (places x) the label space; the planner checks its size before broadcasting.
    """
    return det.drop("occ_score", "suppressed").join(occ.withColumnRenamed("occ", "occ_score"), on, "left").withColumn(
        "suppressed", F.coalesce(F.col("occ_score") < F.lit(cutoff).cast("float"), F.lit(False)))
