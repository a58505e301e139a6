"""What a plausibility filter does: suppression, muddiness, shadowing, filter errors, matched leagues.

Functions read ``hit`` (the detection clears its threshold) and ``implausible`` (the judge's verdict)
and keep the arm (for example ``run_id``) as a key, so all arms and budgets are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.names import genus
from chorale.operators.intervals import any_overlap, flat_overlap, interval_join
from chorale.operators.prefix import exact_quantiles, kth_largest
from chorale.params import Muddiness
from chorale.session import cut

WIN = ["recording_id", "start_s"]


def mark_implausible(det: DataFrame, profile: DataFrame | None = None, mode: str = "geofilter", min_tier: int = 3) -> DataFrame:
    """Add ``implausible`` by the geofilter, the profile, or either; a species absent from a profile is tier 3."""
    if mode == "geofilter":
        return det.withColumn("implausible", F.col("suppressed"))
    if mode not in ("profile", "either"):
        raise ValueError(f"unknown mode {mode!r}")
    if profile is None:
        raise ValueError(f"mode={mode!r} needs a profile")
    d = det.join(profile.where("tier is not null").select("species_key", F.col("tier").alias("_tier")), "species_key", "left")
    off = F.coalesce("_tier", F.lit(3)) >= min_tier
    return d.withColumn("implausible", off | F.col("suppressed") if mode == "either" else off).drop("_tier")


def at_theta(det: DataFrame, theta: float) -> DataFrame:
    return det.withColumn("hit", F.col("score_raw").cast("double") >= F.lit(float(theta)))


def suppression_events(det: DataFrame) -> DataFrame:
    return det.where(F.col("hit") & F.col("implausible"))


def detection_windows(det: DataFrame, arm: list[str]) -> DataFrame:
    return det.where("hit").select(*arm, *WIN).distinct()


def window_masses(det: DataFrame, arm: list[str]) -> DataFrame:
    """Per detection-positive window: muddy or not, and the implausible share of its confident score mass."""
    s = F.col("score_raw").cast("double")
    out = det.where("hit").groupBy(*arm, *WIN).agg(
        F.max("implausible").alias("muddy"), F.sum(s).alias("total"),
        F.sum(F.when(F.col("implausible"), s).otherwise(0.0)).alias("impostor"))
    return out.withColumn("impostor_mass", F.when(F.col("total") > 0, F.col("impostor") / F.col("total")).otherwise(0.0))


def muddy_window_rate(det: DataFrame, arm: list[str]) -> DataFrame:
    w = window_masses(det, arm)
    return w.groupBy(*arm).agg(F.count(F.lit(1)).alias("windows"), F.count_if("muddy").alias("muddy_windows"),
                               (F.count_if("muddy") / F.count(F.lit(1))).alias("muddy_window_rate"))


def per_species_muddiness(det: DataFrame, arm: list[str], cfg: Muddiness = Muddiness()) -> DataFrame:
    """Companions within delta, implausible ones, and impostor mass, averaged per species.

    Counts are range frames over a window's own scores (at most one row per class), so no pair of
    species is ever formed.
    """
    d = det.where("hit").withColumn("_s", F.col("score_raw").cast("double")).withColumn("_imp", F.col("implausible").cast("long"))
    win = Window.partitionBy(*arm, *WIN)
    by = ", ".join([*arm, *WIN])
    near = f"OVER (PARTITION BY {by} ORDER BY _s RANGE BETWEEN {float(cfg.delta)}D PRECEDING AND UNBOUNDED FOLLOWING)"
    f = d.select(
        *arm, "species_key", "_s", F.expr(f"count(1) {near} - 1").alias("c"), F.expr(f"sum(_imp) {near} - _imp").alias("ic"),
        F.try_divide(F.sum(F.when(F.col("implausible"), F.col("_s")).otherwise(0.0)).over(win), F.sum("_s").over(win)).alias("m"))
    return f.groupBy(*arm, "species_key").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("_s").alias("mean_score"), F.avg("c").alias("companions"),
        F.avg("ic").alias("implausible_companions"), F.avg(F.coalesce("m", F.lit(0.0))).alias("impostor_mass"))


def muddiness_spread(per_species: DataFrame, arm: list[str], min_windows: int = 5) -> DataFrame:
    """Median and quartiles over species (one row per class, so ``percentile`` stays small)."""
    q = per_species.where(F.col("windows") >= min_windows).groupBy(*arm).agg(
        F.count(F.lit(1)).alias("species"), F.percentile("companions", [0.25, 0.5, 0.75]).alias("q"))
    return q.select(*arm, "species", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"),
                    (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def shadowed_detections(det: DataFrame, arm: list[str], delta: float = 0.15) -> DataFrame:
    """Plausible hits beside an implausible hit scoring nearly as high; the pair is the result row."""
    hits = det.where("hit")
    a = hits.where(~F.col("implausible")).select(*arm, *WIN, "species_key", "score_raw")
    b = hits.where("implausible").select(*arm, *WIN, F.col("species_key").alias("rival_key"),
                                         F.col("score_raw").alias("rival_score"), F.col("occ_score").alias("rival_occ"))
    gap = F.col("score_raw").cast("double") - F.col("rival_score").cast("double")
    return a.join(b, [*arm, *WIN]).where(
        F.col("rival_score").cast("double") >= F.col("score_raw").cast("double") - F.lit(delta)).withColumn(
        "gap", gap).withColumn("congeneric", genus(F.col("species_key")) == genus(F.col("rival_key")))


def shadowed_pairs(shadowed: DataFrame, arm: list[str], top: int = 20) -> DataFrame:
    """The most frequent offending pairs of each arm."""
    pairs = shadowed.groupBy(*arm, "species_key", "rival_key").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("gap").alias("mean_gap"), F.first("congeneric").alias("congeneric"))
    w = Window.partitionBy(*arm).orderBy(F.col("windows").desc(), "species_key", "rival_key")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def _judged_species(det: DataFrame, ann: DataFrame, arm: list[str]) -> DataFrame:
    """One row per (arm, species): was it ever implausible, ever plausible, is it annotated anywhere."""
    present = ann.select("species_key").distinct().withColumn("present", F.lit(True))
    return det.groupBy(*arm, "species_key").agg(
        F.max("implausible").alias("ever_imp"), F.max(~F.col("implausible")).alias("ever_ok")).join(
        present, "species_key", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def filter_errors(det: DataFrame, ann: DataFrame, arm: list[str], bucket_s: float) -> DataFrame:
    """False suppressions and admissions of the filter, with flags for rates that are zero by construction."""
    hits = det.where("hit")
    agree = interval_join(hits.select(*arm, *WIN, "end_s", "species_key", "implausible"),
                          ann.select("recording_id", "start_s", "end_s", "species_key"),
                          ["recording_id", "species_key"], bucket_s, any_overlap).select(
        *arm, *WIN, "species_key", "implausible").distinct()
    a = agree.groupBy(*arm, "species_key").agg(F.count(F.lit(1)).alias("tp"), F.count_if("implausible").alias("fs"))
    a = a.groupBy(*arm).agg(
        F.sum("tp").alias("true_positive_detections"), F.sum("fs").alias("false_suppressions"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("fs") > 0, F.col("species_key")))), "|").alias("false_suppressed_species"))
    species = _judged_species(det, ann, arm)
    flags = species.groupBy(*arm).agg(
        (F.count_if(F.col("ever_imp") & F.col("present")) == 0).alias("degenerate_false_suppression"),
        (F.count_if(F.col("ever_ok") & ~F.col("present")) == 0).alias("degenerate_false_admission"))
    adm = hits.where(~F.col("implausible")).groupBy(*arm, "species_key").agg(F.count(F.lit(1)).alias("n"))
    adm = adm.join(ann.select("species_key").distinct().withColumn("_p", F.lit(True)), "species_key", "left").groupBy(*arm).agg(
        F.sum("n").alias("admitted_detections"),
        F.sum(F.when(F.col("_p").isNull(), F.col("n")).otherwise(0)).alias("false_admissions"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return flags.join(a, arm, "left").join(adm, arm, "left").select(
        *arm, "degenerate_false_suppression", "degenerate_false_admission", z("true_positive_detections"),
        z("false_suppressions"),
        F.try_divide(F.col("false_suppressions"), F.col("true_positive_detections")).alias("false_suppression_rate"),
        F.coalesce("false_suppressed_species", F.lit("")).alias("false_suppressed_species"), z("admitted_detections"),
        z("false_admissions"),
        F.try_divide(F.col("false_admissions"), F.col("admitted_detections")).alias("false_admission_rate"))


def excluded_present_species(det: DataFrame, ann: DataFrame, arm: list[str], occ_threshold: float) -> DataFrame:
    return det.join(ann.select("species_key").distinct(), "species_key", "left_semi").groupBy(*arm, "species_key").agg(
        F.max("occ_score").alias("max_occ"), F.max("score_raw").alias("max_score")).where(
        F.col("max_occ").cast("double") < occ_threshold)


def theta_for_count(det: DataFrame, arm: list[str], target) -> DataFrame:
    """The theta that yields ``target`` detections per arm (1.0 for an arm without detections is the caller's)."""
    return kth_largest(det, arm, "score_raw", target if not isinstance(target, int) else F.lit(target))


def with_budgets(det: DataFrame, arm: list[str], budgets: list[int]) -> DataFrame:
    """Detections once per budget with that budget's matched theta and ``hit``."""
    b = det.withColumn("budget", F.explode(F.array(*[F.lit(int(x)) for x in budgets])))
    # one row per arm and budget, read by every part of a league
    th = cut(kth_largest(b.select(*arm, "budget", "score_raw"), [*arm, "budget"], "score_raw", F.col("budget")).drop("total"))
    return b.join(th, [*arm, "budget"]).withColumn("hit", F.col("score_raw").cast("double") >= F.col("theta"))


def smallest_arm(det: DataFrame, arm: list[str], theta: float = 0.1) -> DataFrame:
    """The default matched target: the smallest arm's detection count at theta, at least 1."""
    n = det.groupBy(*arm).agg(F.count_if(F.col("score_raw").cast("double") >= theta).alias("n"))
    return n.agg(F.greatest(F.min("n"), F.lit(1)).alias("target"))


def league(det: DataFrame, arm: list[str], cfg: Muddiness, ann: DataFrame | None = None, bucket_s: float = 60.0) -> DataFrame:
    """One comparison row per arm; ``det`` carries hit and implausible.

    The median mass runs over windows, so it is taken by bins, not in one group's memory.
    """
    w = window_masses(det, arm)
    rate = w.groupBy(*arm).agg(F.count(F.lit(1)).alias("detection_windows"),
                               (F.count_if("muddy") / F.count(F.lit(1))).alias("muddy_window_rate"))
    med = exact_quantiles(w, arm, "impostor_mass", {"median_impostor_mass": 0.5})
    counts = det.groupBy(*arm).agg(F.count_if("hit").alias("detections"),
                                   F.count_if(F.col("hit") & F.col("implausible")).alias("suppression_events"))
    sh = shadowed_detections(det, arm, cfg.delta).groupBy(*arm).agg(
        F.count(F.lit(1)).alias("shadowed_detections"), F.count_if("congeneric").alias("congeneric_shadowed"))
    spread = muddiness_spread(per_species_muddiness(det, arm, cfg), arm).select(
        *arm, F.col("median").alias("species_muddiness_median"), F.col("iqr").alias("species_muddiness_iqr"))
    out = counts.join(rate, arm, "left").join(med, arm, "left").join(sh, arm, "left").join(spread, arm, "left").fillna(
        0, ["shadowed_detections", "congeneric_shadowed", "detection_windows"])
    if ann is not None:
        fe = filter_errors(det, ann, arm, bucket_s).select(
            *arm, "false_suppressions", "false_suppression_rate", "false_admissions", "false_admission_rate")
        out = out.join(fe, arm, "left")
    return out


def reported_species(det: DataFrame, arm: list[str]) -> DataFrame:
    return det.where("hit").select(*arm, "species_key").distinct()


def agreement(reported: DataFrame, arm: str, a: str, b: str, ann: DataFrame) -> DataFrame:
    """Species both arms report, only one does, and which of them are annotated."""
    sa = reported.where(F.col(arm) == a).select("species_key")
    sb = reported.where(F.col(arm) == b).select("species_key")
    parts = sa.intersect(sb).withColumn("side", F.lit("both")).unionByName(
        sa.subtract(sb).withColumn("side", F.lit("only a"))).unionByName(sb.subtract(sa).withColumn("side", F.lit("only b")))
    truth = ann.select("species_key").distinct().withColumn("annotated", F.lit(True))
    return parts.join(truth, "species_key", "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))


def top_bottom(per_species: DataFrame, arm: list[str], by: str, n: int) -> DataFrame:
    """The n highest and n lowest species of each arm."""
    hi = Window.partitionBy(*arm).orderBy(F.col(by).desc(), "species_key")
    lo = Window.partitionBy(*arm).orderBy(F.col(by).asc(), "species_key")
    one = lambda w, side: per_species.withColumn("place", F.row_number().over(w)).where(
        F.col("place") <= n).withColumn("end", F.lit(side))
    return one(hi, "top").unionByName(one(lo, "bottom"))


# ------------------------------------------------------------------ at per-species thresholds
def with_truth(det: DataFrame, ann: DataFrame | None, arm: list[str], bucket_s: float) -> DataFrame:
    """Reported detections with ``real``: overlap of at least 0.5 s with a box of the species (NULL without truth)."""
    hits = det.where("above")
    if ann is None:
        return hits.withColumn("real", F.lit(None).cast("boolean"))
    ok = interval_join(hits.select(*arm, *WIN, "end_s", "species_key"),
                       ann.select("recording_id", "start_s", "end_s", "species_key"),
                       ["recording_id", "species_key"], bucket_s, flat_overlap).select(
        *arm, *WIN, "species_key").distinct().withColumn("real", F.lit(True))
    return hits.join(ok, [*arm, *WIN, "species_key"], "left").withColumn("real", F.coalesce("real", F.lit(False)))


def filter_outcomes(judged: DataFrame, arm: list[str]) -> DataFrame:
    """The four outcomes with precision before and after the filter; let through / hidden without truth."""
    i, r = F.col("implausible"), F.col("real")
    o = judged.groupBy(*arm).agg(
        F.count_if(~i & r).alias("correct"), F.count_if(~i & ~r).alias("wrong"), F.count_if(i & ~r).alias("caught_mistake"),
        F.count_if(i & r).alias("hid_real"), F.count_if(~i).alias("let_through"), F.count_if(i).alias("hidden"))
    right = F.col("correct") + F.col("hid_real")
    total = right + F.col("wrong") + F.col("caught_mistake")
    return o.withColumn("precision_before", F.try_divide(right, total)).withColumn(
        "precision_after", F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")))


def recall_with_and_without(songs: DataFrame) -> DataFrame:
    """(found, hid_real, missed) counts -> share of songs found before and after the filter."""
    total = F.col("found") + F.col("hid_real") + F.col("missed")
    return songs.withColumn("recall_before", F.try_divide(F.col("found") + F.col("hid_real"), total)).withColumn(
        "recall_after", F.try_divide(F.col("found"), total))


def impossible_species(judged: DataFrame, arm: list[str]) -> DataFrame:
    return judged.where("implausible").groupBy(*arm, "species_key", "recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score_raw").alias("s"), F.count_if(F.coalesce("real", F.lit(False))).alias("r")
    ).groupBy(*arm, "species_key").agg(
        F.sum("n").alias("detections"), F.count(F.lit(1)).alias("recordings"),
        F.max("s").cast("double").alias("peak"), F.sum("r").alias("real"))


def unreportable(det: DataFrame, ann: DataFrame, arm: list[str]) -> DataFrame:
    """Annotated species the judge calls implausible every time."""
    return _judged_species(det, ann, arm).where(F.col("present") & ~F.col("ever_ok")).select(*arm, "species_key")


def circular(det: DataFrame, ann: DataFrame, arm: list[str]) -> DataFrame:
    """True when no annotated species is ever implausible: a zero would be by construction."""
    return _judged_species(det, ann, arm).groupBy(*arm).agg(
        (F.count_if(F.col("ever_imp") & F.col("present")) == 0).alias("circular"),
        F.count_if("present").alias("annotated_seen"))
