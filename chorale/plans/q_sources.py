"""Queries of sources, sinks and composite reports. Written tables go to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chorale.operators import align as al
from chorale.operators import curves as cv
from chorale.operators import forensics as fx
from chorale.operators import outcomes as oc
from chorale.operators import resample as rs
from chorale.plans import testbed as tb
from chorale.plans.q_labels import _kept
from chorale.plans.q_outcomes import ARM, _per_rec, cov, lab
from chorale.plans.q_outcomes import BUCKET as OBUCKET
from chorale.plans.registry import big, cte, query, r6
from chorale.session import checkpoint_dir
from chorale.sources import annotations as an
from chorale.sources import bundle as bd
from chorale.sources import imports as im
from chorale.sources import tables as st


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/chorale-{name}-{uuid.uuid4().hex[:12]}"


@query("A2_dataset_round_trip", "SELECT recording_id, site, (SELECT count(*) FROM e_ann a WHERE a.recording_id = e_rec.recording_id) AS boxes FROM e_rec")
def a2(spark, d):
    p = _folder(spark, "dataset")
    st.write_dataset(tb.recordings(spark, d), tb.annotations(spark, d).drop("box_id"), p, "ds")
    r, a = st.read_dataset(spark, p, "ds")
    n = a.groupBy("recording_id").agg(F.count(F.lit(1)).alias("boxes"))
    return r.join(n, "recording_id", "left").select("recording_id", "site", F.coalesce("boxes", F.lit(0)).alias("boxes"))


@query("A9_score_store", "SELECT recording_id, count(*) AS windows FROM e_win WHERE run_id = 'runB' GROUP BY 1")
def a9(spark, d):
    p = _folder(spark, "scores")
    st.write_scores(tb.score_windows(spark, d), p)
    return st.read_scores(spark, p, "runB").groupBy("recording_id").agg(F.count(F.lit(1)).alias("windows"))


@query("A10_detections_store", "SELECT recording_id, start_s, species_key, round(score, 6) AS score_raw, rank AS rank_in_window FROM e_det WHERE run_id = 'runA'")
def a10(spark, d):
    p = _folder(spark, "det")
    st.write_detections(tb.detections(spark, d), p)
    return st.read_detections(spark, p, "runA").select("recording_id", "start_s", "species_key", *r6("score_raw"), *big("rank_in_window"))


@query("A11_aligned_store", "SELECT run_id, 'imported' AS truth_ref, count(*) AS pairs FROM e_al GROUP BY 1")
def a11(spark, d):
    p = _folder(spark, "aligned")
    st.write_aligned(tb.aligned(spark, d), p, "ds", "native", "imported", "2024-01-02")
    return st.read_aligned(spark, p, dataset="ds", grid="native").groupBy("run_id", "truth_ref").agg(F.count(F.lit(1)).alias("pairs"))


@query("A12_stale_working_copies", "SELECT 'site' || (r % 5) AS dataset, 'night@w' || r AS truth_ref FROM e_rec WHERE r % 5 = 2 AND r <> 7")
def a12(spark, d):
    r = F.expr("substring(recording_id, 2)")
    listed = tb.recordings(spark, d).select(F.col("site").alias("dataset"), F.lit("runA").alias("run_id"), F.lit("native").alias("grid"), F.concat(F.lit("night@w"), r).alias("truth_ref"))
    return st.stale_working(listed, "site2", "night", "night@w7").select("dataset", "truth_ref")


def _foreign(spark, d, dirty: bool):
    """A foreign model's table with its own column names, from the events; some rows broken when dirty."""
    e, k = tb.events(spark, d), F.col("k")
    start = F.floor(F.col("sec") / 21600) * 21600
    file = F.concat(F.lit("audio/"), F.col("recording_id"), F.lit(".WAV"))
    score = ((F.col("event_id") * 7919) % 1000 / 1000.0)
    if dirty:
        file = F.when(k == 7, F.lit("nowhere.wav")).otherwise(file)
        score = F.when(k == 11, score + 2).otherwise(score)
    cols = [file.alias("Filename"), F.when(F.lit(dirty) & (k == 3), "n/a").otherwise(start.cast("string")).alias("Begin Time (s)"),
            F.when(F.lit(dirty) & (k == 5), start).otherwise(start + 21600).cast("string").alias("End Time (s)"),
            F.when(k % 4 == 0, F.concat(F.upper("species_key"), F.lit("_Common name"))).otherwise(F.col("species_key")).alias("Label"), score.cast("string").alias("Confidence")]
    return e.select(*cols)


@query("A6_import_problems", """SELECT problem, n AS rows FROM (SELECT count(*) FILTER (k = 3) AS a, count(*) FILTER (k = 7) AS b, count(*) FILTER (k = 11) AS c, count(*) FILTER (k = 5) AS e FROM e_ev),
 LATERAL (VALUES ('empty or non-numeric value', a), ('recording not in this project', b), ('score outside 0 to 1', c), ('ends before it starts', e), ('starts after its recording ends', 0)) t(problem, n)""")
def a6p(spark, d):
    return im.problem_counts(im.canonical_rows(_foreign(spark, d, True), tb.recordings(spark, d))).select("problem", *big("rows"))


cte("foreign_det", """SELECT recording_id, (sec // 21600 * 21600)::DOUBLE AS start_s, CASE WHEN species_key = 'Engine' AND k % 4 = 0 THEN 'ENGINE_Common name' ELSE species_key END AS species_key, max(((event_id * 7919) % 1000) / 1000.0::DOUBLE) AS score FROM e_ev GROUP BY 1, 2, 3""")


@query("A5_A6_A7_import_detections", """SELECT recording_id, start_s, species_key, round(score, 6) AS score_raw, row_number() OVER (PARTITION BY recording_id, start_s ORDER BY score DESC, species_key) AS rank_in_window FROM foreign_det""")
def a6(spark, d):
    det = im.prepare(_foreign(spark, d, False), tb.recordings(spark, d), "imported-1")
    return det.select("recording_id", "start_s", "species_key", *r6("score_raw"), *big("rank_in_window"))


@query("A6_import_report", """SELECT (SELECT count(*) FROM foreign_det) AS rows, (SELECT count(DISTINCT recording_id) FROM foreign_det) AS recordings, 9::BIGINT AS species, 2::BIGINT AS other_labels, 21600.0::DOUBLE AS window_s,
 (SELECT median(n)::DOUBLE FROM (SELECT count(*) AS n FROM foreign_det GROUP BY recording_id, start_s)) AS per_window""")
def a6r(spark, d):
    det = im.to_detections(im.canonical_rows(_foreign(spark, d, False), tb.recordings(spark, d)), "imported-1")
    return im.import_report(det).select(*big("rows", "recordings", "species", "other_labels"), *r6("window_s", "per_window"))


@query("A8_template", """SELECT recording, w * 3.0::DOUBLE AS start_s, sp AS species FROM (SELECT recording_id AS recording FROM e_rec ORDER BY recording_id LIMIT 2), range(0, 2) t(w), (VALUES ('Turdus migratorius'), ('Catharus guttatus'), ('Noise')) v(sp)""")
def a8(spark, d):
    return im.template(tb.recordings(spark, d)).select("recording", "start_s", "species")


def _exchange(spark, d):
    n = F.col("box_id").cast("long")
    return tb.annotations(spark, d).select(
        F.concat("recording_id", F.lit(".Table.1.selections.txt")).alias("file"), "start_s", F.when(n % 10 == 0, F.col("start_s")).otherwise(F.col("end_s")).alias("end_s"), "low_hz", "high_hz",
        F.when(n % 8 == 0, F.concat(F.lit("Mystery "), (n % 3).cast("string"))).otherwise(F.upper("species_key")).alias("name"))


def _lookup(spark, d):
    return tb.species(spark, d).select(F.lower("species_key").alias("name"), "species_key")


@query("A13_annotation_rows", """SELECT recording_id, start_s, end_s, species_key FROM e_ann WHERE CAST(box_id AS BIGINT) % 10 <> 0 AND CAST(box_id AS BIGINT) % 8 <> 0""")
def a13(spark, d):
    return an.resolve_boxes(_exchange(spark, d), tb.recordings(spark, d), _lookup(spark, d))[0].select("recording_id", "start_s", "end_s", "species_key")


@query("A13_unmapped_names", "SELECT DISTINCT 'Mystery ' || (CAST(box_id AS BIGINT) % 3) AS name FROM e_ann WHERE CAST(box_id AS BIGINT) % 8 = 0")
def a13u(spark, d):
    return an.resolve_boxes(_exchange(spark, d), tb.recordings(spark, d), _lookup(spark, d))[1]


@query("A3_ingest_codes", "SELECT recording_id, count(*) AS boxes FROM e_ann JOIN spp USING (species_key) WHERE idx <> 5 GROUP BY 1")
def a3(spark, d):
    code = F.concat(F.lower(F.substring("species_key", 1, 4)), F.col("idx").cast("string"))
    canon = tb.species(spark, d).select("species_key", F.when(F.col("idx") != 5, code).otherwise("").alias("ebird_code"))
    raw = tb.annotations(spark, d).join(tb.species(spark, d), "species_key").select(
        F.concat("recording_id", F.lit(".flac")).alias("file"), "start_s", "end_s", "low_hz", "high_hz", code.alias("name"))
    return an.ingest_annotations(raw, canon, tb.recordings(spark, d))[0].groupBy("recording_id").agg(F.count(F.lit(1)).alias("boxes"))


@query("A14_import_boxes", "SELECT recording_id, count(*) AS chunks FROM chunks WHERE recording_id IN (SELECT recording_id FROM e_ann) GROUP BY 1")
def a14(spark, d):
    from chorale.operators.labelsets import import_boxes
    return import_boxes(tb.annotations(spark, d), tb.recordings(spark, d), True, tb.CHUNK_S).groupBy("recording_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("A15_export_boxes", """SELECT b.recording_id || '.wav' AS file, b.start_s, coalesce('Bird ' || s.idx, b.species_key) AS common_name, c.state = 'closed' AS closed FROM boxes b LEFT JOIN spp s USING (species_key)
 JOIN chunks c ON c.recording_id = b.recording_id AND c.i = floor(b.start_s / 43200)""")
def a15(spark, d):
    names = tb.species(spark, d).select("species_key", F.concat(F.lit("Bird "), F.col("idx").cast("string")).alias("common_name"))
    x = an.export_boxes(tb.label_boxes(spark, d), tb.label_chunks(spark, d), tb.recordings(spark, d), names, tb.CHUNK_S)
    return x.select(F.col("Filename").alias("file"), F.col("Start Time (s)").alias("start_s"), F.col("Common Name").alias("common_name"), F.col("Chunk Closed").alias("closed"))


@query("A16_profile_upload", "SELECT species_key, min(k % 4)::BIGINT AS tier FROM e_ev GROUP BY 1")
def a16(spark, d):
    raw = tb.events(spark, d).select(F.upper("species_key").alias("species"), (F.col("k") % 4).cast("string").alias("tier"))
    return im.profile_from_upload(raw, _lookup(spark, d))[0].select("species_key", *big("tier"))


@query("A18_detections_export", "SELECT k.recording_id, k.start_s, k.species_key, coalesce(c.verdict, '') AS verdict FROM kept k LEFT JOIN checks c USING (recording_id, start_s, species_key)")
def a18(spark, d):
    return st.detections_export(_kept(spark, d), tb.checks(spark, d)).select("recording_id", "start_s", "species_key", "verdict")


@query("A20_threshold_export", """SELECT run_id AS arm, species_key, 'native' AS grid, 'Bird ' || idx AS common_name, round(ap, 6) AS ap FROM e_ap JOIN spp USING (species_key)""")
def a20(spark, d):
    t = cv.average_precision(cv.pr_curve(tb.aligned(spark, d), ["run_id", "species_key"]), ["run_id", "species_key"])
    names = tb.species(spark, d).select("species_key", F.concat(F.lit("Bird "), F.col("idx").cast("string")).alias("common_name"))
    arms = {r: t.where(F.col("run_id") == r).drop("run_id") for r in tb.RUNS}
    return st.threshold_export(arms, names, "native").select("arm", "species_key", "grid", "common_name", *r6("ap"))


@query("A21_bundle_candidates", """SELECT recording_id, start_s, species_key, row_number() OVER (ORDER BY recording_id, start_s, species_key) - 1 AS candidate_id, printf('clips/w%06d', dense_rank() OVER (ORDER BY recording_id, start_s) - 1) AS clip FROM kept""")
def a21(spark, d):
    return bd.candidates(_kept(spark, d), "runA", 21600.0 * 8).select("recording_id", "start_s", "species_key", *big("candidate_id"), "clip")


@query("A21_clip_manifest", "SELECT recording_id, min(start_s) - 0.5 AS clip_start_s, max(end_s) + 0.5 AS clip_end_s FROM kept GROUP BY recording_id, start_s")
def a21c(spark, d):
    return bd.clip_manifest(bd.candidates(_kept(spark, d), "runA", 21600.0 * 8)).select("recording_id", "clip_start_s", "clip_end_s")


@query("A21_known_answers", "SELECT verdict, count(*) AS n FROM kept JOIN checks USING (recording_id, start_s, species_key) WHERE verdict <> 'unsure' GROUP BY 1")
def a21k(spark, d):
    return bd.known_answers(bd.candidates(_kept(spark, d), "runA", 21600.0 * 8), tb.checks(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("A21_truth_rows", "SELECT kind, count(*) AS n FROM (SELECT 'box' AS kind FROM truth_boxes WHERE species_key <> 'unknown bird' UNION ALL SELECT 'segment' FROM cover) GROUP BY 1")
def a21t(spark, d):
    t = al.truth_from_set(tb.label_chunks(spark, d), tb.label_boxes(spark, d), tb.recordings(spark, d), tb.CHUNK_S)
    return bd.truth_rows(t["annotations"], t["coverage"], "night").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("A21_species_recordings", "SELECT DISTINCT recording_id, site FROM kept JOIN e_rec USING (recording_id)")
def a21s(spark, d):
    c = _kept(spark, d)
    return bd.recording_rows(tb.recordings(spark, d), c).select("recording_id", "site")


def length_scorer(batches):
    """A stand-in detector: scores from the window's place in its recording (a model would read the audio)."""
    for pdf in batches:
        place = ((pdf["start_s"] // 21600) % 7).astype(int)
        yield pdf.assign(scores=[[i / 10 if i == p else 0.0 for i in range(7)] for p in place])


@query("A22_score_run", "SELECT recording_id, count(*) AS windows, round(sum(((start_s / 21600) % 7) / 10), 4) AS mass FROM e_win WHERE run_id = 'runA' AND CAST(substr(recording_id, 2) AS BIGINT) % 3 <> 0 GROUP BY 1")
def a22(spark, d):
    r = tb.recordings(spark, d)
    done = r.where(F.expr("substring(recording_id, 2)").cast("long") % 3 == 0)
    s = im.score_run(r, done, 21600.0, 21600.0, length_scorer, "mine")
    mass = F.aggregate(F.transform("scores", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return s.groupBy("recording_id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum(mass), 4).alias("mass"))


# ------------------------------------------------------------------ composite reports
@query("Z1_evaluate", """SELECT run_id, round(cmap, 6) AS cmap, round(micro_ap, 6) AS micro_ap, damaged FROM (SELECT run_id, avg(ap) AS cmap FROM e_ap GROUP BY 1)
 JOIN (SELECT run_id, sum(dp * precision) / max(n_pos) AS micro_ap FROM e_micro GROUP BY 1) USING (run_id) JOIN (SELECT run_id, median(f) < 0.5 AS damaged FROM (SELECT run_id, species_key, count(DISTINCT score) / k AS f FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, species_key ORDER BY score DESC) AS i, least(n, greatest(2 * p, 100)) AS k FROM (SELECT run_id, species_key, score, sum(y_true) OVER (PARTITION BY run_id, species_key) AS p,
 count(*) OVER (PARTITION BY run_id, species_key) AS n FROM e_al)) WHERE p >= 10 AND i <= k GROUP BY run_id, species_key, k) GROUP BY 1) USING (run_id)""")
def z1(spark, d):
    a = tb.aligned(spark, d)
    caveat = cv.rank_resolution_summary(cv.rank_resolution(a, ["run_id", "species_key"]), ["run_id"]).select("run_id", "damaged")
    return cv.summary(a, ["run_id"]).join(caveat, "run_id").select("run_id", *r6("cmap", "micro_ap"), "damaged")


@query("Z4_benchmark_card", """SELECT c.run_id, round((c + h) / nullif(c + h + w + m, 0), 6) AS precision, round(quantile_cont(u.precision, 0.025), 6) AS lo, round(quantile_cont(u.precision, 0.975), 6) AS hi FROM (SELECT run_id,
 count(*) FILTER (y_true = 1 AND NOT hidden) AS c, count(*) FILTER (y_true = 1 AND hidden) AS h, count(*) FILTER (y_true = 0 AND NOT hidden) AS w, count(*) FILTER (y_true = 0 AND hidden) AS m FROM lab WHERE hit GROUP BY 1) c
 JOIN u_sums u ON u.run_id = c.run_id GROUP BY 1, 2""")
def z4(spark, d):
    f = lab(spark, d)
    card = oc.report_outcomes(f, ARM)
    total = F.col("correct") + F.col("hid_real") + F.col("wrong") + F.col("caught_mistake")
    iv = rs.bootstrap(_per_rec(spark, d), ARM, n=1000).where("stat = 'precision'").select(*ARM, "lo", "hi")
    return card.select(*ARM, F.try_divide(F.col("correct") + F.col("hid_real"), total).alias("precision")).join(iv, ARM).select(*ARM, *r6("precision", "lo", "hi"))


@query("Z6_geofilter_report", """SELECT run_id, round((c + h) / (c + h + w + m), 6) AS precision_before, round(c / (c + w), 6) AS precision_after, round((sf + sh) / (sf + sh + sm), 6) AS recall_before, round(sf / (sf + sh + sm), 6) AS recall_after
 FROM (SELECT run_id, count(*) FILTER (is_real AND NOT implausible) AS c, count(*) FILTER (NOT is_real AND NOT implausible) AS w, count(*) FILTER (NOT is_real AND implausible) AS m, count(*) FILTER (is_real AND implausible) AS h FROM judged GROUP BY 1)
 JOIN (SELECT run_id, count(*) FILTER (outcome = 'found') AS sf, count(*) FILTER (outcome = 'filter hid a real bird') AS sh, count(*) FILTER (outcome = 'missed') AS sm FROM cov GROUP BY 1) USING (run_id)""")
def z6(spark, d):
    j = fx.filter_outcomes(fx.with_truth(tb.thresholded(spark, d), tb.annotations(spark, d), ARM, OBUCKET), ARM)
    s = fx.recall_with_and_without(oc.singing_outcomes(cov(spark, d), ARM)).select(*ARM, "recall_before", "recall_after")
    return j.join(s, ARM).select(*ARM, *r6("precision_before", "precision_after", "recall_before", "recall_after"))
