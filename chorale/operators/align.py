"""Truth meets scores: window labels, grid projection, the dense aligned frame, truth of a label set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.intervals import (LONG_AGO, chunks_touched, interval_join, labels_window, merge_spans,
                                         open_ended, within, within_or_last)
from chorale.params import MIN_OVERLAP_S, UNKNOWN_BIRD
from chorale.session import spread

WIN = ["run_id", "recording_id", "start_s"]


def label_windows(windows: DataFrame, boxes: DataFrame, bucket_s: float, keys: list[str],
                  floor_s: float = MIN_OVERLAP_S) -> DataFrame:
    """Distinct (window, species) that a box labels, on the windows the model produced."""
    rule = lambda a, b, c, d: labels_window(a, b, c, d, floor_s)
    return interval_join(windows, boxes.select("recording_id", "start_s", "end_s", "species_key"), ["recording_id"],
                         bucket_s, rule).select(*keys, "species_key").distinct()


def unknown_labels(boxes: DataFrame, species: DataFrame) -> DataFrame:
    """Boxes of species outside the label space; must be empty before labelling."""
    return boxes.join(species.select("species_key").distinct(), "species_key", "left_anti")


def dense_scores(score_windows: DataFrame, vocab: list[str], species: list[str], labels: str | None = None, hidden: str | None = None) -> DataFrame:
    """Every window with every evaluation species; a species missing from the vocabulary scores 0. ``labels``: an array
    column of the species that are true of a window, which become ``y_true``; ``hidden``: one of those that the judge hides.

    The vocabulary is run metadata, so the picked classes are fixed positions in the array and the
    dense frame is an explode of each row: no join.
    """
    at = {v: i for i, v in enumerate(vocab)}
    among = lambda column, s: F.coalesce(F.array_contains(column, s), F.lit(False))
    said = lambda s: [*([among(labels, s).cast("int").alias("y_true")] if labels else []), *([among(hidden, s).alias("hidden")] if hidden else [])]
    cells = F.array(*[F.struct(
        F.lit(s).alias("species_key"),
        (F.element_at("scores", at[s] + 1) if s in at else F.lit(0.0)).cast("float").alias("score"), *said(s)) for s in species])
    return score_windows.select(*WIN, "end_s", F.explode(cells).alias("c")).select(*WIN, "end_s", "c.*")


def with_species(score_windows: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Every window with the set of its species in ``rows``, no longer than the vocabulary; NULL without any. What is said of
    windows and species meets windows here, before they become a row per species."""
    return score_windows.join(rows.groupBy(*WIN).agg(F.collect_set("species_key").alias(name)), WIN, "left")


def labelled_windows(score_windows: DataFrame, boxes: DataFrame, bucket_s: float, floor_s: float = MIN_OVERLAP_S) -> DataFrame:
    """Every window with the set of species that are true of it, as ``labels``."""
    return with_species(score_windows, label_windows(score_windows.select(*WIN, "end_s"), boxes, bucket_s, WIN, floor_s), "labels")


def align_windows(score_windows: DataFrame, vocab: list[str], species: list[str], boxes: DataFrame,
                  bucket_s: float, floor_s: float = MIN_OVERLAP_S) -> DataFrame:
    """The dense truth/score frame on the native grid. Windows meet their labels before they become a row per species."""
    return dense_scores(labelled_windows(score_windows, boxes, bucket_s, floor_s), vocab, species, "labels")


def project_scores(long_scores: DataFrame, recordings: DataFrame, window_s: float, hop_s: float) -> DataFrame:
    """Scores on another grid: each frame takes the maximum of the source windows over it, 0 where none.

    Source windows explode to the frames they touch and combine by max, so only the frame
    maxima are shuffled.
    """
    keys = [c for c in ("run_id", "recording_id", "species_key") if c in long_scores.columns]
    lo = F.greatest(F.lit(0), F.floor((F.col("start_s") - window_s) / hop_s) + 1)
    hi = F.ceil(F.col("end_s") / hop_s) - 1
    spread = long_scores.where(hi >= lo).withColumn("i", F.explode(F.sequence(lo, hi)))
    best = spread.groupBy(*keys, "i").agg(F.max("score").alias("score"))
    n = F.floor((F.col("duration_s") - window_s) / hop_s) + 1
    got = best.join(recordings.select("recording_id", n.alias("_n")), "recording_id").where(F.col("i") < F.col("_n"))
    return got.select(*keys, (F.col("i") * hop_s).cast("double").alias("start_s"),
                      (F.col("i") * hop_s + window_s).cast("double").alias("end_s"), "score")


def densify(projected: DataFrame, recordings: DataFrame, runs: list[str], species: list[str], window_s: float,
            hop_s: float) -> DataFrame:
    """Frames nothing covered keep 0, for every run and species of the evaluation."""
    n = F.greatest(F.lit(0), F.floor((F.col("duration_s") - window_s) / hop_s) + 1)
    grid = spread(recordings.where(n > 0).select("recording_id", "duration_s"), "recording_id").select(
        "recording_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn(
        "c", F.explode(F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(s).alias("species_key"))
                                 for r in runs for s in species])))
    cells = grid.select("c.run_id", "recording_id", "c.species_key", (F.col("i") * hop_s).cast("double").alias("start_s"),
                        (F.col("i") * hop_s + window_s).cast("double").alias("end_s"))
    return cells.join(projected.drop("end_s"), ["run_id", "recording_id", "species_key", "start_s"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0).cast("float")))


def label_long(frames: DataFrame, boxes: DataFrame, bucket_s: float, keys: list[str]) -> DataFrame:
    """y_true for a long (window, species) frame."""
    wins = frames.select(*keys, "end_s").distinct()
    hits = label_windows(wins, boxes, bucket_s, keys).withColumn("y_true", F.lit(1))
    return frames.join(hits, [*keys, "species_key"], "left").withColumn("y_true", F.coalesce("y_true", F.lit(0)))


def closed_time_only(aligned: DataFrame, coverage: DataFrame, complete: DataFrame, recordings: DataFrame,
                     bucket_s: float) -> DataFrame:
    """Incomplete recordings keep only windows wholly inside closed time; complete ones keep all: their coverage is one
    span without ends."""
    names = complete.select("recording_id").distinct()
    spans = open_ended(coverage.join(names, "recording_id", "left_anti"), recordings).unionByName(
        names.select("recording_id", F.lit(LONG_AGO).alias("start_s"), F.lit(float("inf")).alias("end_s")))
    return within(aligned, spans, bucket_s)


def align_meta(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts stored with an aligned frame."""
    per = aligned.groupBy(*keys, "recording_id", "start_s").agg(
        F.count(F.lit(1)).alias("c"), F.sum("y_true").alias("p"))
    a = per.groupBy(*keys, "recording_id").agg(F.count(F.lit(1)).alias("w"), F.sum("c").alias("c"), F.sum("p").alias("p"))
    b = aligned.select(*keys, "species_key").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_species"))
    return a.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recordings"), F.sum("w").alias("n_windows"), F.sum("c").alias("n_pairs"),
        F.sum("p").alias("n_positive")).join(b, keys)


# ------------------------------------------------------------------ truth of a label set
def truth_from_set(chunks: DataFrame, boxes: DataFrame, recordings: DataFrame, chunk_s: float = 60.0) -> dict[str, DataFrame]:
    """What a label set says is there: boxes touching a closed chunk, and the time that was closed.

    Returns annotations, unknown (counted, never scored), coverage, covered (seconds), complete.
    """
    closed = chunks.where("state = 'closed'").join(recordings.select("recording_id"), "recording_id", "left_semi")
    covered = closed.groupBy("recording_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s"))
    complete = covered.join(recordings.select("recording_id", "duration_s"), "recording_id").where(
        "covered_s >= duration_s - 1.0").select("recording_id")
    hit = chunks_touched(boxes, chunk_s).join(
        closed.select("recording_id", F.col("start_s").alias("chunk")), ["recording_id", "chunk"], "left_semi")
    kept = boxes.join(hit.select("box_id").distinct(), "box_id", "left_semi")
    return {
        "annotations": kept.where(F.col("species_key") != UNKNOWN_BIRD),
        "unknown": kept.where(F.col("species_key") == UNKNOWN_BIRD),
        "coverage": merge_spans(closed, ["recording_id"], chunk_s * 64),
        "covered": covered, "complete": complete, "closed": closed}


def imported_truth(recordings: DataFrame, ann: DataFrame) -> dict[str, DataFrame]:
    """The annotations a dataset came with: every labelled recording counts end to end."""
    lab = recordings.where("labelled")
    return {"annotations": ann.join(lab.select("recording_id"), "recording_id", "left_semi"),
            "coverage": lab.select("recording_id", F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")),
            "covered": lab.select("recording_id", F.col("duration_s").alias("covered_s")),
            "complete": lab.select("recording_id")}


def labelled_only(df: DataFrame, truth: dict[str, DataFrame], recordings: DataFrame, whole: bool, bucket_s: float) -> DataFrame:
    """The rows a truth can judge: whole recordings, or windows inside closed time."""
    if whole:
        return df.join(truth["complete"], "recording_id", "left_semi")
    return within_or_last(df, truth["coverage"], recordings, bucket_s)

