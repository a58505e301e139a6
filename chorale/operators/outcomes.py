"""Scorecards and benchmark outcomes at given thresholds, for every species and arm at once.

``lab`` is an aligned frame with theta, hit and hidden. All functions take ``arm`` key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.names import is_species
from chorale.operators.intervals import interval_join, labels_window, merge_spans, union_length, with_previous
from chorale.params import MIN_OVERLAP_S

WIN = ["recording_id", "start_s"]
POS = "y_true = 1"


def label_windows(aligned: DataFrame, thetas: DataFrame, on: list[str], hidden: DataFrame | None = None,
                  arm: list[str] = ()) -> DataFrame:
    """Add theta, hit (never without a theta) and hidden (the judge's rows, unless ``aligned`` says already what is hidden)."""
    lab = aligned.join(thetas.select(*on, "theta"), on, "left").withColumn(
        "hit", F.coalesce(F.col("score").cast("double") >= F.col("theta"), F.lit(False)))
    if hidden is None:
        return lab if "hidden" in aligned.columns else lab.withColumn("hidden", F.lit(False))
    k = [*arm, *WIN, "species_key"]
    h = hidden.select(*k).distinct().withColumn("hidden", F.lit(True))
    return lab.join(h, k, "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


# ------------------------------------------------------------------ scorecard
def counts(lab: DataFrame, keys: list[str]) -> DataFrame:
    """Opportunity, caught, missed, false alarms, silence and the two rates, per key."""
    pos, hit = F.col("y_true") == 1, F.col("hit")
    c = lab.groupBy(*keys).agg(
        F.count_if(pos).alias("opportunity"), F.count_if(hit & pos).alias("caught"),
        F.count_if(~hit & pos).alias("missed"), F.count_if(hit & ~pos).alias("false_alarms"),
        F.count_if(~hit & ~pos).alias("correct_silence"), F.count(F.lit(1)).alias("windows"),
        F.max("score").cast("double").alias("best_score"))
    return c.withColumn("precision", F.try_divide(F.col("caught"), F.col("caught") + F.col("false_alarms"))).withColumn(
        "recall", F.try_divide(F.col("caught"), F.col("opportunity")))


def box_coverage(lab: DataFrame, ann: DataFrame, arms: list[dict], arm: list[str], bucket_s: float,
                 floor_s: float = MIN_OVERLAP_S) -> DataFrame:
    """One row per (arm, box): the windows it owns, how many fired (shown / hidden), the best score.

    The windows a box owns are exactly those alignment labelled positive for it, so only positive
    rows are joined. ``arms``: the key values of the arms to list every box for.
    """
    pos = lab.where(POS).select(*arm, *WIN, "end_s", "species_key", "score", "hit", "hidden")
    rule = lambda a, b, c, d: labels_window(a, b, c, d, floor_s)
    owned = interval_join(pos, ann.select("recording_id", "start_s", "end_s", "species_key", "box_id"),
                          ["recording_id", "species_key"], bucket_s, rule)
    per = owned.groupBy(*arm, "box_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("hit").alias("caught"),
        F.count_if(F.col("hit") & ~F.col("hidden")).alias("shown"), F.count_if(F.col("hit") & F.col("hidden")).alias("hid"),
        F.max("score").cast("double").alias("best_score"))
    every = ann
    if arm:
        listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in a.items()]) for a in arms])
        every = ann.withColumn("_a", F.explode(listed)).select("*", "_a.*").drop("_a")
    return every.join(per, [*arm, "box_id"], "left").fillna(0, ["windows", "caught", "shown", "hid"]).withColumn(
        "duration_s", F.col("end_s") - F.col("start_s")).withColumn("detected", F.col("caught") > 0)


def box_summary(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes, detected, missed; a box that owns no window was never asked about."""
    from chorale.operators.prefix import exact_quantiles
    asked = F.col("windows") > 0
    c = cov.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if("detected").alias("detected"),
        F.count_if(asked & ~F.col("detected")).alias("missed"), F.count_if(~asked).alias("unrepresentable"),
        F.sum("windows").alias("windows"), F.sum("caught").alias("caught"))
    med = exact_quantiles(cov, keys, "duration_s", {"median_duration_s": 0.5}, bin_of=lambda x: F.floor(x))
    return c.withColumn("detection_rate", F.try_divide(F.col("detected"), F.col("boxes") - F.col("unrepresentable"))).join(med, keys)


def detection_overview(cov: DataFrame, thetas: DataFrame, arm: list[str]) -> DataFrame:
    """Box-level detection rate of every species; a species without a theta is unreachable, not zero."""
    per = cov.groupBy(*arm, "species_key", "recording_id").agg(
        F.count(F.lit(1)).alias("b"), F.count_if(F.col("windows") == 0).alias("na"), F.sum("duration_s").alias("s"),
        F.count_if("detected").alias("d"))
    t = per.groupBy(*arm, "species_key").agg(
        F.sum("b").alias("boxes"), F.sum("na").alias("not_asked"), F.count(F.lit(1)).alias("recordings"),
        F.sum("s").alias("seconds"), F.sum("d").alias("d"))
    t = t.join(thetas.select("species_key", "theta"), "species_key", "left")
    ok = F.col("theta").isNotNull()
    ask = F.col("boxes") - F.col("not_asked")
    return t.select(*arm, "species_key", "boxes", ask.alias("askable"), "not_asked", "recordings", "seconds", "theta",
                    ok.alias("reachable"), F.when(ok, F.col("d")).otherwise(0).alias("detected"),
                    F.when(ok, F.try_divide(F.col("d"), ask)).alias("detection_rate"))


def species_index(aligned: DataFrame, ann: DataFrame, arm: list[str]) -> DataFrame:
    wins = aligned.groupBy(*arm, "species_key").agg(F.count_if(F.expr(POS)).alias("opportunity"))
    boxes = ann.groupBy("species_key", "recording_id").agg(
        F.count(F.lit(1)).alias("b"), F.sum(F.col("end_s") - F.col("start_s")).alias("s")).groupBy("species_key").agg(
        F.sum("b").alias("boxes"), F.sum("s").alias("seconds"), F.count(F.lit(1)).alias("recordings"))
    return wins.join(boxes, "species_key", "left").fillna(0, ["boxes", "seconds", "recordings"])


def timeline(lab: DataFrame) -> DataFrame:
    pos = F.col("y_true") == 1
    return lab.withColumn("outcome", F.when(pos & F.col("hit"), "caught").when(pos, "missed")
                          .when(F.col("hit"), "false alarm").otherwise("correct silence"))


def mistaken_for(lab: DataFrame, arm: list[str], top: int = 8, quantile: bool = False) -> DataFrame:
    """Per focal species: what the arm reported in the windows where it sang and was missed.

    Rows meet inside one window, where only missed species meet reported ones.
    """
    missed = lab.where((F.col("y_true") == 1) & ~F.col("hit")).select(*arm, *WIN, F.col("species_key").alias("focal"))
    n = missed.groupBy(*arm, "focal").agg(F.count(F.lit(1)).alias("_n"))
    hits = lab.where("hit").select(*arm, *WIN, "species_key", "y_true", "score")
    both = missed.join(hits, [*arm, *WIN]).where(F.col("focal") != F.col("species_key"))
    t = both.groupBy(*arm, "focal", "species_key").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.expr(POS)).alias("also_annotated"))
    if quantile:
        from chorale.operators.prefix import exact_quantiles
        t = t.join(exact_quantiles(both, [*arm, "focal", "species_key"], "score", {"median_score": 0.5}),
                   [*arm, "focal", "species_key"])
    w = Window.partitionBy(*arm, "focal").orderBy(F.col("windows").desc(), "species_key")
    return t.join(n, [*arm, "focal"]).withColumn("share", F.col("windows") / F.col("_n")).withColumn(
        "_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r", "_n")


# ------------------------------------------------------------------ benchmark
def report_outcomes(lab: DataFrame, keys: list[str]) -> DataFrame:
    t, h = F.col("y_true") == 1, F.col("hidden")
    return lab.where("hit").groupBy(*keys).agg(
        F.count_if(t & ~h).alias("correct"), F.count_if(t & h).alias("hid_real"), F.count_if(~t & ~h).alias("wrong"),
        F.count_if(~t & h).alias("caught_mistake"))


def false_events(lab: DataFrame, arm: list[str], block_s: float) -> DataFrame:
    """Shown wrong detections as events: consecutive wrong windows of a species are one mistake."""
    k = [*arm, "recording_id", "species_key"]
    wrong = lab.where(F.col("hit") & (F.col("y_true") == 0) & ~F.col("hidden")).select(*k, "start_s", "end_s")
    d = with_previous(wrong, k, ["end_s"], block_s)
    new = F.col("prev_end_s").isNull() | (F.col("start_s") > F.col("prev_end_s") + 1e-6)
    return d.groupBy(*k).agg(F.count_if(new).alias("events"))


def hours_of(recordings: DataFrame) -> DataFrame:
    return recordings.select("recording_id", (F.col("duration_s") / 3600).alias("hours"))


def false_per_hour(events: DataFrame, arms_hours: DataFrame, arm: list[str]) -> DataFrame:
    """``arms_hours``: (arm, hours); an arm without events has 0 per hour."""
    e = events.groupBy(*arm).agg(F.sum("events").alias("events"))
    return arms_hours.join(e, arm, "left").withColumn("events", F.coalesce("events", F.lit(0))).withColumn(
        "false_per_hour", F.when(F.col("hours") > 0, F.col("events") / F.col("hours")))


def vocalisation_outcomes(cov: DataFrame) -> DataFrame:
    """Each box: found, filter hid a real bird, missed, or not asked (owns no window)."""
    return cov.withColumn("outcome", F.when(F.col("windows") == 0, "not asked").when(F.col("shown") > 0, "found")
                          .when(F.col("hid") > 0, "filter hid a real bird").otherwise("missed"))


def singing_outcomes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    o = F.col("outcome")
    return boxes.groupBy(*keys).agg(F.count_if(o == "found").alias("found"),
                                    F.count_if(o == "filter hid a real bird").alias("hid_real"),
                                    F.count_if(o == "missed").alias("missed"))


def per_species(lab: DataFrame, boxes: DataFrame, arm: list[str]) -> DataFrame:
    k = [*arm, "species_key"]
    win = lab.groupBy(*k).agg(F.count_if(F.expr(POS)).alias("n_positive"), F.count_if("hit").alias("reported"),
                              F.count_if(F.col("hit") & (F.col("y_true") == 1)).alias("right"))
    voc = boxes.where("outcome <> 'not asked'").groupBy(*k).agg(
        F.count(F.lit(1)).alias("vocalisations"), F.count_if(F.col("outcome") == "found").alias("found_n"))
    return win.join(voc, k, "left").fillna(0, ["vocalisations", "found_n"]).select(
        *k, "n_positive", "vocalisations", "found_n", F.try_divide("found_n", "vocalisations").alias("found"), "reported",
        F.try_divide("right", "reported").alias("precision"))


def by_recording(lab: DataFrame, boxes: DataFrame, arm: list[str], block_s: float) -> DataFrame:
    """Songs found and false events per (recording, species); reported-only rows are kept."""
    k = [*arm, "recording_id", "species_key"]
    songs = boxes.where("outcome <> 'not asked'").groupBy(*k).agg(
        F.count(F.lit(1)).alias("songs"), F.count_if(F.col("outcome") == "found").alias("found_n"))
    return songs.join(false_events(lab, arm, block_s), k, "full_outer").fillna(0, ["songs", "found_n", "events"]).select(
        *k, "songs", "found_n", F.try_divide("found_n", "songs").alias("found"), F.col("events").alias("false_events"))


def crowd(det: DataFrame, arm: list[str], delta: float, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(companions, summary) of every focal species: other reported species within delta of it.

    Rows meet inside one window. Carries ``strength`` when present.
    """
    st = F.col("strength") if "strength" in det.columns else F.lit(None).cast("double")
    d = det.where("above").select(*arm, *WIN, "species_key", F.col("score_raw").cast("double").alias("s"), "implausible",
                                  st.alias("st"))
    focal = d.select(*arm, *WIN, F.col("species_key").alias("focal"), F.col("s").alias("fs"), F.col("st").alias("fst"))
    n = focal.groupBy(*arm, "focal").agg(F.count(F.lit(1)).alias("n"), F.avg("fs").alias("focal_score"),
                                         F.avg("fst").alias("focal_strength"))
    comp = d.join(focal, [*arm, *WIN]).where((F.col("species_key") != F.col("focal")) & (F.col("s") >= F.col("fs") - F.lit(delta)))
    t = comp.groupBy(*arm, "focal", "species_key").agg(
        F.count(F.lit(1)).alias("windows"), F.max("implausible").alias("implausible"), F.avg("s").alias("score"),
        F.avg("fs").alias("focal_score"), F.avg("st").alias("strength"), F.avg("fst").alias("focal_strength"),
        F.count_if("implausible").alias("_imp"))
    totals = t.groupBy(*arm, "focal").agg(F.sum("windows").alias("_c"), F.sum("_imp").alias("_i"))
    summary = n.join(totals, [*arm, "focal"], "left").select(
        *arm, "focal", F.col("n").alias("windows"), (F.coalesce("_c", F.lit(0)) / F.col("n")).alias("companions"),
        (F.coalesce("_i", F.lit(0)) / F.col("n")).alias("implausible_companions"), "focal_score", "focal_strength")
    w = Window.partitionBy(*arm, "focal").orderBy(F.col("windows").desc(), "species_key")
    table = t.join(n.select(*arm, "focal", "n"), [*arm, "focal"]).withColumn("share", F.col("windows") / F.col("n")).withColumn(
        "_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r", "_imp", "n")
    return table, summary


def species_lists(det: DataFrame, ann: DataFrame, arms: list[dict], arm: list[str], k: int = 1) -> DataFrame:
    """Each recording's list after k detections against the annotations, with the outcome."""
    key = [*arm, "recording_id", "species_key"]
    c = det.where(F.col("above") & is_species(F.col("species_key"))).groupBy(*key).agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(~F.col("implausible")).alias("shown"))
    truth = ann.select("recording_id", "species_key").distinct().withColumn(
        "_a", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in a.items()]) for a in arms]))).select(
        *[f"_a.{x}" for x in arm], "recording_id", "species_key", F.lit(True).alias("annotated"))
    rows = c.join(truth, key, "full_outer").fillna(0, ["detections", "shown"]).withColumn(
        "annotated", F.coalesce("annotated", F.lit(False)))
    listed, shown, real = F.col("detections") >= k, F.col("shown") >= k, F.col("annotated")
    return rows.withColumn("outcome", F.when(listed & shown & real, "correct").when(listed & shown, "wrong")
                           .when(listed & real, "filter hid a real bird").when(listed, "filter caught a mistake")
                           .when(real, "missed")).where(F.col("outcome").isNotNull())


def species_list_summary(lists: DataFrame, arm: list[str]) -> DataFrame:
    o = F.col("outcome")
    per = lists.groupBy(*arm, "recording_id").agg(
        *[F.count_if(o == x).alias(n) for n, x in (("correct", "correct"), ("hid_real", "filter hid a real bird"),
          ("wrong", "wrong"), ("caught_mistake", "filter caught a mistake"), ("missed", "missed"))])
    listed, annotated = F.col("correct") + F.col("wrong"), F.col("correct") + F.col("hid_real") + F.col("missed")
    t = per.groupBy(*arm).agg(
        *[F.sum(c).alias(c) for c in ("correct", "hid_real", "wrong", "caught_mistake", "missed")],
        F.avg(listed).alias("listed_per_recording"), F.avg(annotated).alias("annotated_per_recording"))
    return t.withColumn("recall", F.try_divide(F.col("correct"), annotated)).withColumn(
        "precision", F.try_divide(F.col("correct"), listed))


def coverage_groups(boxes: DataFrame, models: list[str], arm: str) -> DataFrame:
    """Which models find each species at all: all, only one, some, none."""
    found = boxes.groupBy("species_key", arm).agg(F.max(F.col("outcome") == "found").alias("f"))
    who = found.groupBy("species_key").agg(F.sort_array(F.collect_set(F.when(F.col("f"), F.col(arm)))).alias("who"))
    n = F.size("who")
    return who.select("species_key", F.when(n == len(models), "all models").when(
        (n == 1) & F.lit(len(models) > 1), F.concat(F.lit("only "), F.try_element_at("who", F.lit(1)))).when(n == 0, "no model")
        .otherwise("some, not all").alias("grp"))


def chance_precision(lab: DataFrame, arm: list[str]) -> DataFrame:
    r = lab.groupBy(*arm, "species_key").agg(F.count_if("hit").alias("rep"), F.avg((F.col("y_true") == 1).cast("int")).alias("rate"))
    return r.groupBy(*arm).agg(F.try_divide(F.sum(F.col("rep") * F.col("rate")), F.sum("rep")).alias("chance_precision"))


def flagged_fraction(lab: DataFrame, arms_hours: DataFrame, arm: list[str], block_s: float) -> DataFrame:
    """Share of the audio inside at least one reported window of any species, at most 1."""
    hit = lab.where("hit").select(*arm, *WIN, "end_s").distinct()
    c = union_length(hit, [*arm, "recording_id"], block_s).groupBy(*arm).agg(F.sum("covered_s").alias("c"))
    return arms_hours.join(c, arm, "left").select(*arm, F.when(
        F.col("hours") > 0, F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) / (F.col("hours") * 3600))).alias("flagged"))


def per_second_precision(lab: DataFrame, ann: DataFrame, arm: list[str], block_s: float, bucket_s: float) -> DataFrame:
    """Of the whole seconds claimed for a species, how many hold a labelled sound of it.

    Whole-second intervals are merged on both sides and intersected, so no second is ever
    materialised as a row.
    """
    whole = lambda df: df.withColumn("start_s", F.floor("start_s").cast("double")).withColumn(
        "end_s", F.ceil("end_s").cast("double"))
    k = [*arm, "recording_id", "species_key"]
    said = merge_spans(whole(lab.where("hit").select(*k, "start_s", "end_s")), k, block_s)
    real = merge_spans(whole(ann.select("recording_id", "species_key", "start_s", "end_s")), ["recording_id", "species_key"], block_s)
    claimed = said.groupBy(*arm).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("claimed"))
    ov = interval_join(said, real, ["recording_id", "species_key"], bucket_s,
                       lambda a, b, c, d: F.least(b, d) > F.greatest(a, c))
    right = ov.groupBy(*arm).agg(F.sum(F.least("end_s", "b_end") - F.greatest("start_s", "b_start")).alias("right"))
    return claimed.join(right, arm, "left").select(
        *arm, F.try_divide(F.coalesce("right", F.lit(0.0)), F.col("claimed")).alias("per_second_precision"))


def summary(lab: DataFrame, boxes: DataFrame, ann: DataFrame, recordings: DataFrame, arm: list[str], block_s: float,
            bucket_s: float) -> DataFrame:
    """The headline card of every arm."""
    ah = lab.select(*arm, "recording_id").distinct().join(hours_of(recordings), "recording_id").groupBy(*arm).agg(
        F.sum("hours").alias("hours"))
    rep = report_outcomes(lab, arm)
    pos = lab.groupBy(*arm).agg(F.count_if(F.expr(POS)).alias("positives"))
    sing = singing_outcomes(boxes, arm).select(*arm, F.col("found").alias("f"), F.col("hid_real").alias("fh"), F.col("missed").alias("fm"))
    fph = false_per_hour(false_events(lab, arm, block_s), ah, arm).select(*arm, "false_per_hour")
    out = ah.join(rep, arm, "left").fillna(0, ["correct", "hid_real", "wrong", "caught_mistake"]).join(pos, arm).join(
        sing, arm, "left").join(fph, arm).join(chance_precision(lab, arm), arm, "left").join(
        flagged_fraction(lab, ah, arm, block_s), arm, "left").join(
        per_second_precision(lab, ann, arm, block_s, bucket_s), arm, "left")
    right = F.col("correct") + F.col("hid_real")
    return out.select(
        *arm, "correct", "hid_real", "wrong", "caught_mistake", F.col("f").alias("songs_found"), F.col("fh").alias("songs_hidden"),
        F.col("fm").alias("songs_missed"), F.try_divide(right, right + F.col("wrong") + F.col("caught_mistake")).alias("precision"),
        F.try_divide(right, F.col("positives")).alias("window_recall"),
        F.try_divide(F.col("f"), F.col("f") + F.col("fh") + F.col("fm")).alias("found"), "false_per_hour", "hours",
        "chance_precision", "flagged", "per_second_precision")
