"""Exploration queries: lanes, navigators, window tables, suggestions, activity guides, project status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.names import display_name, guide_species, is_species, tier_label, xc_species_url
from chorale.operators.intervals import any_overlap, interval_join, labels_window, merge_spans
from chorale.operators.prefix import positions

WIN = ["recording_id", "start_s"]


def lane_blocks(det: DataFrame, arm: list[str], per_window: int = 3) -> DataFrame:
    """The top species per window, visible and suppressed apart; ``hit`` rows only."""
    w = Window.partitionBy(*arm, *WIN, "suppressed").orderBy(F.col("score_raw").desc(), "species_key")
    return det.where("hit").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_window)


def window_at(det: DataFrame, keys: list[str], t: Column) -> DataFrame:
    """Each model's latest window containing instant t."""
    return det.where((F.col("start_s") <= t) & (F.col("end_s") > t)).groupBy(*keys).agg(
        F.max("start_s").alias("start_s"), F.max_by("end_s", "start_s").alias("end_s"))


def first_detection(det: DataFrame, keys: list[str], t0: float, t1: float) -> DataFrame:
    return det.where(F.col("hit") & (F.col("end_s") > t0) & (F.col("start_s") < t1)).groupBy(*keys).agg(F.min("start_s").alias("start_s"))


def label_anchors(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The widest block per species of a view (ties: earliest)."""
    return blocks.groupBy(*keys, "species_key").agg(
        F.max_by(F.struct("start_s", "end_s"), F.struct(F.col("end_s") - F.col("start_s"), -F.col("start_s"))).alias("b")).select(
        *keys, "species_key", "b.*")


def species_spans(det: DataFrame, keys: list[str], block_s: float) -> DataFrame:
    """A species' merged hit windows with the top score; span and score meet again on the covering interval."""
    k = [*keys, "species_key"]
    hits = det.where("hit").select(*k, "start_s", "end_s", "score_raw")
    spans = merge_spans(hits, k, block_s)
    best = interval_join(hits, spans, k, block_s, any_overlap).groupBy(*k, "b_start").agg(F.max("score_raw").alias("score_raw"))
    return spans.join(best.withColumnRenamed("b_start", "start_s"), [*k, "start_s"])


def focus_options(det: DataFrame, ann: DataFrame, arm: str) -> DataFrame:
    """Every species annotated or detected in a recording, and on which side."""
    seen = det.where("hit").select("recording_id", "species_key", F.col(arm).alias("m")).distinct().withColumn("t", F.lit(False))
    truth = ann.select("recording_id", "species_key").distinct().withColumn("m", F.lit(None).cast("string")).withColumn("t", F.lit(True))
    return seen.unionByName(truth).groupBy("recording_id", "species_key").agg(
        F.max("t").alias("in_truth"), F.count("m").alias("n_models"))


def mark_correct(det: DataFrame, ann: DataFrame, arm: list[str], bucket_s: float) -> DataFrame:
    """Whether the species is annotated in that window, by the alignment rule."""
    k = [*arm, *WIN, "species_key"]
    ok = interval_join(det.select(*k, "end_s"), ann.select("recording_id", "start_s", "end_s", "species_key"),
                       ["recording_id", "species_key"], bucket_s, labels_window).select(*k).distinct().withColumn("correct", F.lit(True))
    return det.join(ok, k, "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def _bins(df: DataFrame, n_bins: int) -> DataFrame:
    """A row per bin a row overlaps; ``bin_s`` is the recording's bin length."""
    last = F.lit(n_bins - 1)
    clip = lambda x: F.least(F.greatest(F.floor(x / F.col("bin_s")), F.lit(0)), last)
    lo, hi = clip(F.col("start_s")), clip(F.col("end_s") - 1e-9)
    return df.withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def navigator_bins(det: DataFrame, ann: DataFrame, recordings: DataFrame, arms: list[dict], arm: list[str], n_bins: int, bucket_s: float
                   ) -> DataFrame:
    """Per arm, recording and bin: distinct species by best outcome, missed and annotated, with names. Every bin appears."""
    dur = recordings.select("recording_id", (F.col("duration_s") / n_bins).alias("bin_s"))
    d = mark_correct(det.where("above"), ann, arm, bucket_s).withColumn("o", F.when(F.col("correct") & ~F.col("implausible"), 0).when(
        F.col("correct"), 1).when(~F.col("implausible"), 2).otherwise(3))
    k = [*arm, "recording_id", "bin"]
    best = _bins(d.join(dur, "recording_id"), n_bins).groupBy(*k, "species_key").agg(F.min("o").alias("o"))
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in a.items()]) for a in arms]))
    truth = _bins(ann.join(dur, "recording_id"), n_bins).select("recording_id", "bin", "species_key").distinct().withColumn("_a", each).select(
        *[f"_a.{x}" for x in arm], "recording_id", "bin", "species_key", F.lit(True).alias("t"))
    both = best.join(truth, [*k, "species_key"], "full_outer").withColumn("missed", F.coalesce("t", F.lit(False)) & ~F.coalesce(F.col("o") <= 1, F.lit(False)))
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("species_key")))), "|")
    cols = [("correct", F.col("o") == 0), ("hid_real", F.col("o") == 1), ("wrong", F.col("o") == 2), ("caught_mistake", F.col("o") == 3),
            ("missed", F.col("missed")), ("truth", F.col("t"))]
    agg = both.groupBy(*k).agg(*[x for n, c in cols for x in (F.count_if(c).alias(f"n_{n}"), names(c).alias(f"names_{n}"))])
    grid = dur.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).withColumn("_a", each).select(
        *[f"_a.{x}" for x in arm], "recording_id", F.col("bin").cast("long").alias("bin"), (F.col("bin") * F.col("bin_s")).alias("bin_start_s"),
        ((F.col("bin") + 1) * F.col("bin_s")).alias("bin_end_s"))
    out = grid.join(agg, k, "left")
    return out.fillna(0, [f"n_{n}" for n, _ in cols]).fillna("", [f"names_{n}" for n, _ in cols])


def lane_lines(det_with_strength: DataFrame, ann: DataFrame, arm: list[str], bucket_s: float) -> DataFrame:
    return mark_correct(det_with_strength.where("above"), ann, arm, bucket_s)


def window_table(det: DataFrame, keys: list[str], t: Column, profile: DataFrame, names: DataFrame, top_n: int = 6) -> DataFrame:
    """What every model says about the same instant, each in its own window containing it."""
    at = window_at(det, keys, t).withColumnRenamed("end_s", "_e")
    d = det.join(at, [*keys, "start_s"], "left_semi")
    w = Window.partitionBy(*keys, "start_s").orderBy(F.col("score_raw").desc(), "species_key")
    d = d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n)
    d = d.join(profile.select("species_key", "tier"), "species_key", "left").join(names.select("species_key", "common_name"), "species_key", "left")
    label = F.concat(F.format_string("%.0f", "start_s"), F.lit("–"), F.format_string("%.0f", "end_s"), F.lit("s"))
    return d.withColumns({"window": label, "species": display_name(F.col("species_key"), F.col("common_name")),
                          "tier": tier_label(F.col("tier")), "xeno_canto": xc_species_url(F.col("species_key"))}).drop("common_name")


def box_suggestions(long_scores: DataFrame, boxes: DataFrame, arm: str, bucket_s: float, top: int = 10) -> DataFrame:
    """For every box: each model ranks its species' best score over the windows meeting it, and ranks are fused by 1/rank."""
    s = long_scores.where(is_species(F.col("species_key"))).select(arm, "recording_id", "start_s", "end_s", F.col("species_key").alias("sp"), "score")
    j = interval_join(boxes.select("box_id", "recording_id", "start_s", "end_s"), s, ["recording_id"], bucket_s, any_overlap)
    best = j.groupBy("box_id", arm, "sp").agg(F.max("score").alias("score"))
    w = Window.partitionBy("box_id", arm).orderBy(F.col("score").desc(), "sp")
    ranked = best.withColumn("rank", F.row_number().over(w))
    f = ranked.groupBy("box_id", "sp").agg(F.sum(F.lit(1.0) / F.col("rank")).alias("support"), F.max("score").alias("best_score"))
    ww = Window.partitionBy("box_id").orderBy(F.col("support").desc(), "sp")
    return f.withColumn("place", F.row_number().over(ww)).where(F.col("place") <= top).withColumnRenamed("sp", "species_key")


def activity_windows(det: DataFrame, arm: list[str], share: float) -> DataFrame:
    """Windows whose best species score clears the bar the top ``share`` of the arm's windows clear ('higher' quantile)."""
    top = det.where(guide_species(F.col("species_key"))).groupBy(*arm, *WIN, "end_s").agg(F.max("score_raw").alias("best"))
    pos = positions(top, arm, "best", descending=False)
    at = F.ceil((F.col("total") - 1) * (1 - share) - 1e-9)
    bar = pos.groupBy(*arm).agg(F.min(F.when(F.col("upto") > at, F.col("best"))).alias("bar"))
    return top.join(bar, arm).where(F.col("best") >= F.col("bar"))


def activity_bins(windows: DataFrame, recordings: DataFrame, n_bins: int, block_s: float) -> DataFrame:
    """Share of each bin the union of guide windows covers."""
    dur = recordings.select("recording_id", (F.col("duration_s") / n_bins).alias("bin_s"))
    spans = merge_spans(windows, ["recording_id"], block_s, tol=0.0)
    b = _bins(spans.join(dur, "recording_id"), n_bins)
    ov = F.greatest(F.lit(0.0), F.least(F.col("end_s"), (F.col("bin") + 1) * F.col("bin_s")) - F.greatest(F.col("start_s"), F.col("bin") * F.col("bin_s")))
    cov = b.groupBy("recording_id", "bin").agg(F.sum(ov).alias("c"))
    grid = dur.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return grid.join(cov, ["recording_id", "bin"], "left").select(
        "recording_id", "bin", F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) / F.col("bin_s")).alias("activity"))


def dataset_summary(recordings: DataFrame, ann: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Counts per dataset. ``scored``: (dataset, run_id, recording_id)."""
    r = recordings.groupBy(key).agg(F.count(F.lit(1)).alias("recordings"), F.round(F.sum("duration_s") / 3600, 1).alias("hours"), F.max("labelled").alias("labelled"))
    a = ann.groupBy(key).agg(F.count(F.lit(1)).alias("annotations"))
    per = scored.select(key, "run_id", "recording_id").distinct().groupBy(key, "run_id").agg(F.count(F.lit(1)).alias("n"))
    runs = per.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.concat("run_id", F.lit(" ("), F.col("n").cast("string"), F.lit(" scored)")))), ", ").alias("runs"))
    return r.join(a, key, "left").join(runs, key, "left").withColumn("annotations", F.coalesce("annotations", F.lit(0))).withColumn("runs", F.coalesce("runs", F.lit("—")))


def flow_progress(recordings: DataFrame, scored: DataFrame, chunks: DataFrame, sample: DataFrame, aligned_for: DataFrame, key: str) -> DataFrame:
    """Step states per dataset: models, labelled, analysed, and the step to continue with."""
    n = recordings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    per = scored.select(key, "run_id", "recording_id").distinct().groupBy(key, "run_id").agg(F.count(F.lit(1)).alias("c"))
    runs = per.join(n, key).groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("c") >= F.col("n")).alias("full"))
    closed = chunks.where("state = 'closed'").select("recording_id", "start_s")
    done = sample.join(closed.withColumn("_c", F.lit(True)), ["recording_id", "start_s"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("_c")).alias("done"))
    ch = chunks.groupBy(key).agg(F.count_if(F.col("state") == "closed").alias("closed"))
    al = aligned_for.select(key).distinct().withColumn("aligned", F.lit(True))
    d = n.join(runs, key, "left").join(done, key, "left").join(ch, key, "left").join(al, key, "left").fillna(0, ["runs", "full", "sampled", "done", "closed"])
    models = F.when(F.col("full") > 0, "done").when(F.col("runs") > 0, "partial").otherwise("todo")
    labelled = F.when(F.col("sampled") > 0, F.when(F.col("done") >= F.col("sampled"), "done").when(F.col("done") > 0, "partial").otherwise("todo")).when(
        F.col("closed") > 0, "partial").otherwise("todo")
    d = d.withColumn("models", models).withColumn("labelled", labelled).withColumn("analysed", F.when(F.coalesce("aligned", F.lit(False)), "done").otherwise("todo"))
    nxt = F.when(F.col("models") != "done", "models").when(F.col("labelled").isin("todo", "partial"), "labelled").when(F.col("analysed") == "todo", "analysed")
    return d.select(key, "models", "labelled", "analysed", nxt.alias("next"), "sampled", "done")


def recording_status(recordings: DataFrame, chunks: DataFrame, sample: DataFrame) -> DataFrame:
    """Seconds labelled and queued per recording."""
    closed = chunks.where("state = 'closed'")
    lab = closed.groupBy("recording_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("labelled_s"))
    q = sample.join(closed.select("recording_id", "start_s"), ["recording_id", "start_s"], "left_anti").groupBy("recording_id").agg(
        F.sum(F.col("end_s") - F.col("start_s")).alias("queued_s"))
    return recordings.select("recording_id", "duration_s").join(lab, "recording_id", "left").join(q, "recording_id", "left").fillna(0.0, ["labelled_s", "queued_s"])


