"""Queries of label sets, exploration and candidate checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.operators import calibrate as cb
from chorale.operators import explore as ex
from chorale.operators import labelsets as ls
from chorale.operators import thresholds as th
from chorale.operators.align import truth_from_set
from chorale.plans import testbed as tb
from chorale.plans.registry import big, cte, query, r6

BUCKET, BLOCK, CH = 21600.0, 21600.0 * 32, tb.CHUNK_S
ARM = ["run_id"]
ARMS = [{"run_id": r} for r in tb.RUNS]


# ------------------------------------------------------------------ label sets
def _edits(spark, d):
    """Edits of existing boxes and new ones: every 7th box is moved, every 13th deleted, every 17th copied as new."""
    n = F.col("box_id").cast("long")
    b = tb.label_boxes(spark, d)
    kinds = F.filter(F.array(F.when(n % 7 == 0, "update"), F.when(n % 13 == 0, "delete"), F.when(n % 17 == 0, "add")), lambda x: x.isNotNull())
    e = b.withColumn("action", F.explode(kinds))
    step = F.when(F.col("action") == "update", 1).when(F.col("action") == "delete", 2).otherwise(3)
    return e.withColumns({"start_s": F.when(F.col("action") == "update", F.col("start_s") + 600).otherwise(F.col("start_s")),
                          "box_id": F.when(F.col("action") == "add", F.concat(F.lit("n"), "box_id")).otherwise(F.col("box_id")),
                          "at": step, "seq": n * 10 + step})


cte("edits", """SELECT CASE WHEN a = 'add' THEN 'n' || box_id ELSE box_id END AS box_id, recording_id, CASE WHEN a = 'update' THEN start_s + 600 ELSE start_s END AS start_s, end_s, species_key, a AS act, s,
 CAST(box_id AS BIGINT) * 10 + s AS seq FROM boxes, (VALUES ('update', 1, 7), ('delete', 2, 13), ('add', 3, 17)) t(a, s, m) WHERE CAST(box_id AS BIGINT) % m = 0""")
cte("touching", """SELECT e.box_id, e.seq FROM edits e JOIN chunks c ON c.recording_id = e.recording_id AND c.state = 'closed' AND c.i BETWEEN floor(e.start_s / 43200) AND floor(greatest(e.start_s, e.end_s - 1e-6) / 43200)
 UNION SELECT e.box_id, e.seq FROM edits e JOIN boxes b USING (box_id) JOIN chunks c ON c.recording_id = b.recording_id AND c.state = 'closed' AND c.i BETWEEN floor(b.start_s / 43200) AND floor(greatest(b.start_s, b.end_s - 1e-6) / 43200)""")
cte("good_edits", "SELECT * FROM edits WHERE end_s > start_s AND (box_id, seq) NOT IN (SELECT (box_id, seq) FROM touching) QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY s DESC, seq DESC) = 1")


@query("L1_apply_edits", """SELECT box_id, recording_id, start_s, species_key FROM boxes WHERE box_id NOT IN (SELECT box_id FROM good_edits)
 UNION ALL SELECT box_id, recording_id, start_s, species_key FROM good_edits WHERE act <> 'delete'""")
def l1(spark, d):
    return ls.apply_edits(tb.label_boxes(spark, d), _edits(spark, d), tb.label_chunks(spark, d), CH)[0].select("box_id", "recording_id", "start_s", "species_key")


@query("L1_rejected_edits", "SELECT count(*) AS rejected FROM edits WHERE NOT (end_s > start_s AND (box_id, seq) NOT IN (SELECT (box_id, seq) FROM touching))")
def l1b(spark, d):
    return ls.apply_edits(tb.label_boxes(spark, d), _edits(spark, d), tb.label_chunks(spark, d), CH)[1].agg(F.count(F.lit(1)).alias("rejected"))


@query("L2_chunk_states", """SELECT recording_id, (c * 43200)::DOUBLE AS start_s, arg_max(CASE WHEN k % 3 = 0 THEN 'open' ELSE 'closed' END, (sec, event_id)) AS state, arg_max('u' || (k % 5), (sec, event_id)) AS who
 FROM (SELECT *, sec // 43200 AS c FROM e_ev) GROUP BY 1, 2""")
def l2(spark, d):
    e = tb.events(spark, d).select(
        "recording_id", (F.floor(F.col("sec") / CH) * CH).alias("start_s"), F.when(F.col("k") % 3 == 0, "open").otherwise("closed").alias("state"),
        F.concat(F.lit("u"), (F.col("k") % 5).cast("string")).alias("who"), F.lit("").alias("reason"), F.col("sec").alias("at"), F.col("event_id").alias("seq"))
    return ls.chunk_states(e).select("recording_id", "start_s", "state", "who")


@query("L3_imported_set", "SELECT recording_id, (i * 43200)::DOUBLE AS start_s, ((i + 1) * 43200)::DOUBLE AS end_s, 'closed' AS state FROM e_rec, range(0, 60) t(i) WHERE recording_id IN (SELECT recording_id FROM e_ann)")
def l3(spark, d):
    return ls.import_boxes(tb.annotations(spark, d), tb.recordings(spark, d), True, CH).select("recording_id", "start_s", "end_s", "state")


@query("L4_publish_next_version", "SELECT site, (max(r % 4) + 1)::BIGINT AS next_version FROM e_rec GROUP BY 1")
def l4(spark, d):
    r = tb.recordings(spark, d)
    v = None
    for i in range(4):
        p = ls.publish(r.where(F.expr("substring(recording_id, 2)").cast("long") % 4 == i), i)
        v = p if v is None else v.unionByName(p)
    return ls.next_version(v, ["site"]).select("site", *big("next_version"))


_BAND = "CASE WHEN h >= 21 OR h < 4 THEN 'night' WHEN h < 8 THEN 'dawn' WHEN h < 17 THEN 'day' ELSE 'dusk' END"
cte("schunk", f"SELECT recording_id, start_s, site || ' · ' || {_BAND} AS stratum, md5('3:' || recording_id || ':' || CAST(start_s AS BIGINT)) AS h2 FROM (SELECT recording_id, site, (i * 10800)::DOUBLE AS start_s, (i * 3) % 24 AS h FROM e_rec, range(0, 240) t(i))")
cte("salloc", """SELECT stratum, c, give + CASE WHEN row_number() OVER (ORDER BY share - give DESC, stratum DESC) <= 120 - sum(give) OVER () THEN 1 ELSE 0 END AS give FROM (
 SELECT stratum, c, 120.0 * c / sum(c) OVER () AS share, greatest(1, floor(120.0 * c / sum(c) OVER ())) AS give FROM (SELECT stratum, count(*) AS c FROM schunk GROUP BY 1))""")


@query("L5_draw_sample", """SELECT recording_id, start_s, stratum, (row_number() OVER (ORDER BY r, stratum) - 1)::BIGINT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, h2) AS r FROM (
 SELECT *, row_number() OVER (PARTITION BY stratum, recording_id ORDER BY h2) AS k FROM schunk)) JOIN salloc USING (stratum) WHERE r <= give""")
def l5(spark, d):
    return ls.draw_sample(tb.recordings(spark, d), 120, 3, chunk_s=10800.0).select("recording_id", "start_s", "stratum", F.col("order").cast("long").alias("ord"))


@query("L6_whole_recordings", """SELECT recording_id, start_s, ord::BIGINT AS ord, false AS whole FROM sampled UNION ALL SELECT recording_id, start_s, (SELECT max(ord) + 1 FROM sampled) + row_number() OVER (ORDER BY r DESC, start_s) - 1, true
 FROM chunks WHERE r % 10 = 3 AND (recording_id, start_s) NOT IN (SELECT (recording_id, start_s) FROM sampled)""")
def l6(spark, d):
    r = F.expr("substring(recording_id, 2)").cast("long")
    chosen = tb.recordings(spark, d).where(r % 10 == 3).select("recording_id", (-r).alias("rank"))
    return ls.add_whole_recordings(tb.sampled(spark, d), tb.recordings(spark, d), chosen, CH).select("recording_id", "start_s", F.col("order").cast("long").alias("ord"), "whole")


@query("L7_next_chunk", "SELECT recording_id, start_s FROM sampled WHERE (recording_id, start_s) NOT IN (SELECT (recording_id, start_s) FROM chunks WHERE state = 'closed') ORDER BY ord LIMIT 1")
def l7(spark, d):
    return ls.next_chunk(tb.sampled(spark, d), tb.label_chunks(spark, d)).select("recording_id", "start_s")


@query("L8_progress", """SELECT count(*) AS closed_chunks, round(sum(end_s - start_s) / 60, 6) AS minutes, count(DISTINCT recording_id) AS recordings, (SELECT count(*) FROM truth_boxes WHERE species_key <> 'unknown bird') AS boxes,
 (SELECT count(*) FROM truth_boxes WHERE species_key = 'unknown bird') AS unknown, (SELECT count(DISTINCT species_key) FROM truth_boxes WHERE species_key <> 'unknown bird') AS n_species,
 (SELECT count(*) FROM boxes WHERE assisted) AS assisted, (SELECT count(*) FROM boxes) AS all_boxes, (SELECT count(*) FROM sampled) AS sample_size,
 count(*) FILTER ((recording_id, start_s) IN (SELECT (recording_id, start_s) FROM sampled)) AS sample_closed, count(*) FILTER ((recording_id, start_s) NOT IN (SELECT (recording_id, start_s) FROM sampled)) AS by_hand,
 (SELECT count(*) FROM chunks WHERE state = 'open') AS open_with_boxes FROM closedc""")
def l8(spark, d):
    p = ls.progress(tb.label_chunks(spark, d), tb.label_boxes(spark, d), tb.sampled(spark, d), tb.recordings(spark, d), CH)
    return p.select(*big("closed_chunks", "recordings", "boxes", "unknown", "n_species", "assisted", "all_boxes", "sample_size", "sample_closed", "by_hand", "open_with_boxes"), *r6("minutes"))


@query("L8_species_found", "SELECT species_key, count(*) AS boxes, count(DISTINCT (recording_id, floor(start_s / 43200))) AS chunks FROM truth_boxes WHERE species_key <> 'unknown bird' GROUP BY 1")
def l8b(spark, d):
    t = truth_from_set(tb.label_chunks(spark, d), tb.label_boxes(spark, d), tb.recordings(spark, d), CH)
    return ls.species_found(t["annotations"], CH).select("species_key", *big("boxes", "chunks"))


@query("L9_accumulation", """SELECT recording_id, start_s, round(sum((end_s - start_s) / 60) OVER w, 6) AS minutes, (sum(coalesce(n, 0)) OVER w)::BIGINT AS species FROM closedc LEFT JOIN (
 SELECT recording_id, start_s, count(*) AS n FROM (SELECT b.species_key, arg_min((c.recording_id, c.start_s), (c.closed_sec, c.recording_id, c.start_s)) AS f FROM boxes b JOIN closedc c ON c.recording_id = b.recording_id
 AND c.i = floor(b.start_s / 43200) WHERE species_key <> 'unknown bird' GROUP BY 1) t, LATERAL (SELECT f[1] AS recording_id, f[2] AS start_s) GROUP BY 1, 2) USING (recording_id, start_s) WINDOW w AS (ORDER BY closed_sec, recording_id, start_s)""")
def l9(spark, d):
    return ls.accumulation(tb.label_chunks(spark, d), tb.label_boxes(spark, d), CH).select("recording_id", "start_s", *r6("minutes"), *big("species"))


@query("L10_labelling_rate", """SELECT round(sum((end_s - start_s) / 60) / ((sum(gap) FILTER (gap <= 20) + median(gap) FILTER (gap <= 20) * (1 + count(*) FILTER (gap > 20))) / 60), 6) AS rate FROM (
 SELECT *, (closed_sec - lag(closed_sec) OVER (ORDER BY closed_sec, recording_id, start_s)) / 60 AS gap FROM closedc)""")
def l10(spark, d):
    return ls.labelling_rate(tb.label_chunks(spark, d)).select(*r6("rate"))


@query("L11_known_names", "SELECT name, count(*) AS uses FROM (SELECT labeller AS name FROM boxes UNION ALL SELECT closed_by FROM chunks WHERE closed_by <> '') GROUP BY 1")
def l11(spark, d):
    return ls.known_names(tb.label_chunks(spark, d), tb.label_boxes(spark, d))


@query("L12_minutes_by_site_and_band", "SELECT site, CASE WHEN i % 2 = 0 THEN 'night' ELSE 'day' END AS band, round(sum(end_s - start_s) / 60, 6) AS minutes FROM closedc GROUP BY 1, 2")
def l12(spark, d):
    return ls.minutes_by(tb.label_chunks(spark, d)).select("site", "band", *r6("minutes"))


@query("L13_how_much_more", """SELECT run_id, count(DISTINCT recording_id)::BIGINT AS recordings, greatest(count(DISTINCT recording_id), ceil(count(DISTINCT recording_id) * (any_value(w) / 0.02) * (any_value(w) / 0.02) * 0.85))::BIGINT AS lo,
 greatest(count(DISTINCT recording_id), ceil(count(DISTINCT recording_id) * (any_value(w) / 0.02) * (any_value(w) / 0.02) * 1.3))::BIGINT AS hi FROM u_rec JOIN (SELECT run_id, quantile_cont(window_recall, 0.975) - quantile_cont(window_recall, 0.025) AS w
 FROM u_sums GROUP BY 1) USING (run_id) GROUP BY 1""")
def l13(spark, d):
    from chorale.functions.clock import project
    from chorale.operators import resample as rs
    from chorale.plans.q_outcomes import _per_rec
    p = _per_rec(spark, d)
    w = rs.width(rs.bootstrap(p, ARM, n=1000)).where("stat = 'window_recall'").join(p.groupBy(*ARM).agg(F.count(F.lit(1)).alias("recordings")), ARM)
    lo, hi = project(F.col("width"), F.col("recordings"), F.lit(0.02))
    return w.select(*ARM, *big("recordings"), lo.alias("lo"), hi.alias("hi"))


cte("pchunk", f"SELECT recording_id, start_s, site || ' · ' || {_BAND} AS stratum, md5('0:' || recording_id || ':' || CAST(start_s AS BIGINT)) AS h2 FROM (SELECT recording_id, site, (i * 43200)::DOUBLE AS start_s, (i * 12) % 24 AS h FROM e_rec, range(0, 60) t(i) WHERE labelled)")
cte("palloc", """SELECT stratum, c, give - greatest(0, least(give, over - before)) AS give FROM (SELECT *, coalesce(sum(give) OVER (ORDER BY share, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(give) OVER () - 5 AS over FROM (SELECT stratum, c, 5.0 * c / sum(c) OVER () AS share, greatest(1, floor(5.0 * c / sum(c) OVER ())) AS give FROM (SELECT stratum, count(*) AS c FROM pchunk GROUP BY 1)))""")


@query("L14_practice_sample", """SELECT recording_id, start_s, stratum, (row_number() OVER (ORDER BY r, stratum) - 1)::BIGINT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, h2) AS r FROM (
 SELECT *, row_number() OVER (PARTITION BY stratum, recording_id ORDER BY h2) AS k FROM pchunk)) JOIN palloc USING (stratum) WHERE r <= give""")
def l14(spark, d):
    """A few random minutes of labelled recordings, for practice against the given boxes (feedback: G16). Fewer places than strata."""
    return ls.draw_sample(tb.recordings(spark, d).where("labelled"), 5, 0, chunk_s=CH).select("recording_id", "start_s", "stratum", F.col("order").cast("long").alias("ord"))


cte("wpick", """SELECT recording_id, site FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5('4:' || recording_id)) AS turn FROM e_rec) ORDER BY turn, site LIMIT 7""")


@query("L5_with_whole_recordings", """SELECT recording_id, start_s, true AS whole, (row_number() OVER (ORDER BY recording_id, start_s) - 1)::BIGINT AS ord FROM wpick, (SELECT (i * 43200)::DOUBLE AS start_s FROM range(0, 60) t(i))""")
def l5w(spark, d):
    """Seven recordings in full, across sites, and no single chunks."""
    s = ls.draw_sample(tb.recordings(spark, d), 0, 4, chunk_s=CH, whole_recordings=7)
    return s.select("recording_id", "start_s", "whole", F.col("order").cast("long").alias("ord"))


# ------------------------------------------------------------------ exploration
def _hit(spark, d):
    return tb.thresholded(spark, d).withColumn("hit", F.col("above"))


@query("X1_lane_blocks", """SELECT run_id, recording_id, start_s, species_key, suppressed, row_number() OVER (PARTITION BY run_id, recording_id, start_s, suppressed ORDER BY score DESC, species_key) AS place FROM e_det WHERE above
 QUALIFY place <= 2""")
def x1(spark, d):
    return ex.lane_blocks(_hit(spark, d), ARM, 2).select(*ARM, "recording_id", "start_s", "species_key", "suppressed", *big("place"))


@query("X2_first_detection", "SELECT run_id, recording_id, min(start_s) AS start_s FROM e_det WHERE above AND end_s > 500000 AND start_s < 900000 GROUP BY 1, 2")
def x2(spark, d):
    return ex.first_detection(_hit(spark, d), [*ARM, "recording_id"], 500000.0, 900000.0)


@query("X3_label_anchors", "SELECT recording_id, species_key, arg_max(start_s, (end_s - start_s, -start_s)) AS start_s, arg_max(end_s, (end_s - start_s, -start_s)) AS end_s FROM e_ann GROUP BY 1, 2")
def x3(spark, d):
    return ex.label_anchors(tb.annotations(spark, d), ["recording_id"]).select("recording_id", "species_key", "start_s", "end_s")


@query("X4_species_spans", """SELECT run_id, recording_id, species_key, min(start_s) AS start_s, max(end_s) AS end_s, round(max(score), 6) AS score_raw FROM (SELECT *, sum(CASE WHEN prev IS NULL OR start_s > prev + 1e-6 THEN 1 ELSE 0 END)
 OVER (PARTITION BY run_id, recording_id, species_key ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(end_s) OVER (PARTITION BY run_id, recording_id, species_key ORDER BY start_s) AS prev FROM e_det WHERE above)) GROUP BY 1, 2, 3, g""")
def x4(spark, d):
    return ex.species_spans(_hit(spark, d), [*ARM, "recording_id"], BLOCK).select(*ARM, "recording_id", "species_key", "start_s", "end_s", *r6("score_raw"))


@query("X5_focus_options", """SELECT recording_id, species_key, bool_or(t) AS in_truth, count(DISTINCT m) AS n_models FROM (SELECT recording_id, species_key, false AS t, run_id AS m FROM e_det WHERE above
 UNION ALL SELECT recording_id, species_key, true, NULL FROM e_ann) GROUP BY 1, 2""")
def x5(spark, d):
    return ex.focus_options(_hit(spark, d), tb.annotations(spark, d), "run_id").select("recording_id", "species_key", "in_truth", *big("n_models"))


cte("marked", """SELECT d.*, EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = d.recording_id AND a.species_key = d.species_key AND least(a.end_s, d.end_s) - greatest(a.start_s, d.start_s) > 0
 AND least(a.end_s, d.end_s) - greatest(a.start_s, d.start_s) >= least(0.5, a.end_s - a.start_s) - 1e-9) AS correct FROM e_det d""")


@query("X6_mark_correct", "SELECT run_id, recording_id, start_s, species_key, correct FROM marked")
def x6(spark, d):
    return ex.mark_correct(tb.thresholded(spark, d), tb.annotations(spark, d), ARM, BUCKET).select(*ARM, "recording_id", "start_s", "species_key", "correct")


NB = 40
cte("nav_best", f"""SELECT run_id, recording_id, b.bin, species_key, min(CASE WHEN correct AND NOT implausible THEN 0 WHEN correct THEN 1 WHEN NOT implausible THEN 2 ELSE 3 END) AS o FROM marked m
 JOIN range(0, {NB}) b(bin) ON b.bin BETWEEN floor(m.start_s / 64800) AND least({NB - 1}, floor((m.end_s - 1e-9) / 64800)) WHERE above GROUP BY 1, 2, 3, 4""")
cte("nav_truth", f"SELECT DISTINCT run_id, recording_id, b.bin, species_key FROM e_ann m JOIN range(0, {NB}) b(bin) ON b.bin BETWEEN least({NB - 1}, floor(m.start_s / 64800)) AND least({NB - 1}, floor((m.end_s - 1e-9) / 64800)), runs")
_NAV = [("correct", "o = 0"), ("hid_real", "o = 1"), ("wrong", "o = 2"), ("caught_mistake", "o = 3"), ("missed", "t AND NOT coalesce(o <= 1, false)"), ("truth", "t")]


@query("X7_navigator_bins", f"""SELECT r.run_id, e.recording_id, b.bin, b.bin * 64800.0::DOUBLE AS bin_start_s, {', '.join(f"count(*) FILTER ({c}) AS n_{n}, coalesce(string_agg(species_key, '|' ORDER BY species_key) FILTER ({c}), '') AS names_{n}" for n, c in _NAV)}
 FROM e_rec e CROSS JOIN runs r CROSS JOIN range(0, {NB}) b(bin) LEFT JOIN (SELECT run_id, recording_id, bin, species_key, o, coalesce(t, false) AS t FROM nav_best FULL JOIN (SELECT *, true AS t FROM nav_truth)
 USING (run_id, recording_id, bin, species_key)) x ON x.run_id = r.run_id AND x.recording_id = e.recording_id AND x.bin = b.bin GROUP BY 1, 2, 3, 4""")
def x7(spark, d):
    n = ex.navigator_bins(tb.thresholded(spark, d), tb.annotations(spark, d), tb.recordings(spark, d), ARMS, ARM, NB, BUCKET)
    return n.select(*ARM, "recording_id", "bin", "bin_start_s", *big(*[f"n_{x}" for x, _ in _NAV]), *[f"names_{x}" for x, _ in _NAV])


@query("X8_lane_lines", """SELECT run_id, recording_id, start_s, species_key, round(strength, 5) AS strength, correct FROM e_strength JOIN (SELECT run_id, recording_id, start_s, species_key, correct FROM marked)
 USING (run_id, recording_id, start_s, species_key)""")
def x8(spark, d):
    s = th.strength(tb.thresholded(spark, d), ARM)
    return ex.lane_lines(s, tb.annotations(spark, d), ARM, BUCKET).select(*ARM, "recording_id", "start_s", "species_key", F.round("strength", 5).alias("strength"), "correct")


@query("X9_window_table", """SELECT run_id, recording_id, species_key, 'Bird ' || idx AS species, printf('%.0f', start_s) || '–' || printf('%.0f', end_s) || 's' AS "window", CASE coalesce(tier, 3) WHEN 0 THEN 'listed' WHEN 1 THEN 'regular'
 WHEN 2 THEN 'vagrant' ELSE 'implausible' END AS tier, round(score, 6) AS score_raw FROM e_det WHERE start_s <= 1000000 AND end_s > 1000000 AND rank <= 3""")
def x9(spark, d):
    sp = tb.species(spark, d)
    names = sp.select("species_key", F.concat(F.lit("Bird "), F.col("idx").cast("string")).alias("common_name"))
    t = ex.window_table(tb.detections(spark, d), [*ARM, "recording_id"], F.lit(1000000.0), sp, names, 3)
    return t.select(*ARM, "recording_id", "species_key", "species", "window", "tier", *r6("score_raw"))


@query("X10_box_suggestions", f"""SELECT box_id, sp AS species_key, round(support, 6) AS support FROM (SELECT box_id, sp, sum(1.0 / rk) AS support, row_number() OVER (PARTITION BY box_id ORDER BY sum(1.0 / rk) DESC, sp) AS place FROM (
 SELECT box_id, run_id, sp, row_number() OVER (PARTITION BY box_id, run_id ORDER BY max(score) DESC, sp) AS rk FROM (SELECT a.box_id, x.run_id, x.species_key AS sp, x.score FROM e_ann a JOIN e_score x ON x.recording_id = a.recording_id
 AND x.start_s < a.end_s AND x.end_s > a.start_s WHERE regexp_matches(x.species_key, '^[A-Z][a-z]+ [a-z\\-]+( [a-z\\-]+)?$')) GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE place <= 4""")
def x10(spark, d):
    return ex.box_suggestions(tb.scored(spark, d), tb.annotations(spark, d), "run_id", BUCKET, 4).select("box_id", "species_key", *r6("support"))


cte("act_top", "SELECT run_id, recording_id, start_s, end_s, max(score) AS best FROM e_det WHERE regexp_matches(species_key, '^[A-Z][a-z-]+ [a-z-]+') GROUP BY 1, 2, 3, 4")
cte("act", """SELECT t.* FROM act_top t JOIN (SELECT run_id, min(best) AS bar FROM (SELECT run_id, best, row_number() OVER (PARTITION BY run_id ORDER BY best) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM act_top)
 WHERE i >= ceil((n - 1) * 0.7 - 1e-9) GROUP BY 1) USING (run_id) WHERE best >= bar""")


@query("X11_activity_windows", "SELECT run_id, recording_id, start_s, end_s FROM act")
def x11(spark, d):
    return ex.activity_windows(tb.detections(spark, d), ARM, 0.3).select(*ARM, "recording_id", "start_s", "end_s")


cte("act_spans", """SELECT recording_id, min(start_s) AS s, max(end_s) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM act)) GROUP BY recording_id, g""")


@query("X12_X13_activity_bins", f"""SELECT e.recording_id, b.bin, round(least(1.0, coalesce(sum(least(s.e, (b.bin + 1) * 64800) - greatest(s.s, b.bin * 64800)) FILTER (s.s IS NOT NULL), 0) / 64800), 6) AS activity FROM e_rec e CROSS JOIN range(0, {NB}) b(bin)
 LEFT JOIN act_spans s ON s.recording_id = e.recording_id AND s.s < (b.bin + 1) * 64800 AND s.e > b.bin * 64800 GROUP BY 1, 2""")
def x13(spark, d):
    """The union of both runs' guide windows, as a share of every bin."""
    w = ex.activity_windows(tb.detections(spark, d), ARM, 0.3).select("recording_id", "start_s", "end_s")
    return ex.activity_bins(w, tb.recordings(spark, d), NB, BLOCK).select("recording_id", *big("bin"), *r6("activity"))


def _by_site(spark, d, df):
    return df.join(tb.recordings(spark, d).select("recording_id", "site"), "recording_id")


@query("X14_dataset_summary", """SELECT site, count(*) AS recordings, round(sum(duration_s) / 3600, 1) AS hours, bool_or(labelled) AS labelled, any_value(a.n) AS annotations, any_value(w.runs) AS runs FROM e_rec
 JOIN (SELECT site, count(*) AS n FROM e_ann JOIN e_rec USING (recording_id) GROUP BY 1) a USING (site) JOIN (SELECT site, string_agg(run_id || ' (' || n || ' scored)', ', ' ORDER BY run_id) AS runs FROM (
 SELECT site, run_id, count(DISTINCT recording_id) AS n FROM e_win JOIN e_rec USING (recording_id) GROUP BY 1, 2) GROUP BY 1) w USING (site) GROUP BY 1""")
def x14(spark, d):
    return ex.dataset_summary(tb.recordings(spark, d), _by_site(spark, d, tb.annotations(spark, d)), _by_site(spark, d, tb.score_windows(spark, d).drop("scores")), "site")


@query("X15_flow_progress", """SELECT site, 'done' AS models, CASE WHEN d >= s THEN 'done' WHEN d > 0 THEN 'partial' ELSE 'todo' END AS labelled, 'done' AS analysed, CASE WHEN d < s THEN 'labelled' END AS next, s AS sampled, d AS done FROM (
 SELECT c.site, count(*) AS s, count(*) FILTER (c.state = 'closed') AS d FROM sampled s JOIN chunks c USING (recording_id, start_s) GROUP BY 1)""")
def x15(spark, d):
    ch = tb.label_chunks(spark, d)
    return ex.flow_progress(tb.recordings(spark, d), _by_site(spark, d, tb.score_windows(spark, d).drop("scores")), ch, _by_site(spark, d, tb.sampled(spark, d)),
                            _by_site(spark, d, tb.aligned(spark, d).select("recording_id").distinct()), "site").select(
        "site", "models", "labelled", "analysed", "next", *big("sampled", "done"))


@query("X16_recording_status", """SELECT recording_id, duration_s, coalesce(l, 0.0) AS labelled_s, coalesce(q, 0.0) AS queued_s FROM e_rec LEFT JOIN (SELECT recording_id, sum(end_s - start_s) AS l FROM closedc GROUP BY 1) USING (recording_id)
 LEFT JOIN (SELECT recording_id, sum(end_s - start_s) AS q FROM sampled WHERE (recording_id, start_s) NOT IN (SELECT (recording_id, start_s) FROM closedc) GROUP BY 1) USING (recording_id)""")
def x16(spark, d):
    return ex.recording_status(tb.recordings(spark, d), tb.label_chunks(spark, d), tb.sampled(spark, d))


# ------------------------------------------------------------------ candidate checking
def _p(df):
    """Chances from a fixed typical curve."""
    return df.withColumn("off", F.lit(0.0)).withColumn("p", cb.sigmoid(cb.logit(F.col("score")) * 1.137 - 0.527))


PX = "1.0 / (1 + exp(-(1.137 * ln(least(greatest(score, 1e-9), 1 - 1e-9) / (1 - least(greatest(score, 1e-9), 1 - 1e-9))) - 0.527)))"
cte("pp", f"SELECT *, {PX} AS p FROM pool")


@query("E1_candidate_pool", "SELECT recording_id, start_s, species_key, round(score, 6) AS score, rank FROM e_det WHERE run_id = 'runB' AND rank <= 3 AND score >= 0.05")
def e1(spark, d):
    return cb.candidate_pool(tb.detections(spark, d).where("run_id = 'runB'"), "birdnet").select("recording_id", "start_s", "species_key", *r6("score"), *big("rank"))


def _species(spark, d):
    sp = tb.species(spark, d)
    names = sp.where("idx <> 8").select("species_key", F.concat(F.lit("Bird "), F.col("idx").cast("string")).alias("common_name"))
    return cb.species_table(tb.pool(spark, d), sp.where("tier is not null"), names)


cte("esp", """SELECT species_key, count(*) AS detections, max(score) AS best, max(s.occ) AS occ, coalesce(any_value(s.tier), 3) AS tier, any_value(s.idx) AS idx, coalesce(any_value(s.tier), 3) <= 2 AND max(s.occ) >= 0.005 AS plausible
 FROM pool JOIN spp s USING (species_key) GROUP BY 1""")


@query("E2_species_table", """SELECT species_key, detections, round(best, 6) AS best, round(occ, 6) AS occ, tier::BIGINT AS tier, plausible, NOT plausible AND best >= 0.5 AS unexpected, CASE WHEN idx = 8 THEN '' ELSE 'Bird ' || idx END AS name,
 plausible AS include, plausible AND detections < 700 AS researcher FROM esp""")
def e2(spark, d):
    return cb.few_detections(_species(spark, d), 700).select("species_key", *big("detections"), *r6("best", "occ"), *big("tier"), "plausible", "unexpected", "name", "include", "researcher")


@query("E3_latest_checks", """SELECT recording_id, start_s, species_key, verdict FROM (SELECT recording_id, (sec // 43200 * 43200)::DOUBLE AS start_s, species_key, arg_max(CASE WHEN k % 11 = 0 THEN 'yes' WHEN k % 3 = 0 THEN 'no' WHEN k % 3 = 1 THEN 'unsure' ELSE 'yes' END,
 (sec, event_id)) AS verdict, arg_max(k % 10 = 0, (sec, event_id)) AS gone FROM e_ev GROUP BY 1, 2, 3) WHERE NOT gone""")
def e3(spark, d):
    k = F.col("k")
    ev = tb.events(spark, d).select(
        "recording_id", (F.floor(F.col("sec") / CH) * CH).alias("start_s"), "species_key", F.when(k % 3 == 0, "no").when(k % 3 == 1, "unsure").otherwise("yes").alias("verdict"),
        (k % 11 == 0).alias("reference"), F.when(k % 10 == 0, "remove").otherwise("add").alias("action"), F.col("sec").alias("at"), F.col("event_id").alias("seq"))
    return cb.latest_checks(ev).select("recording_id", "start_s", "species_key", "verdict")


# species by place and ten days: many with few answers, so that each is at a stage of its own
cte("loc", "SELECT event_id, recording_id, sec, species_key || ' ' || recording_id || '.' || (sec // 864000) AS species_key, k FROM e_ev")
cte("loc_spp", "SELECT species_key, min(event_id) AS e FROM loc GROUP BY 1")
cte("loc_checks", """SELECT recording_id, sec::DOUBLE AS start_s, species_key, arg_max(CASE WHEN k % 11 = 0 THEN 'yes' WHEN k % 3 = 0 THEN 'no' WHEN k % 3 = 1 THEN 'unsure' ELSE 'yes' END, event_id) AS verdict FROM loc GROUP BY 1, 2, 3""")
cte("loc_pool", """SELECT recording_id, (sec + off)::DOUBLE AS start_s, (sec + off + 3)::DOUBLE AS end_s, species_key, max(CAST(CAST((event_id * m) % 1000 / 1000.0::DOUBLE AS FLOAT) AS DOUBLE)) AS score
 FROM loc, (VALUES (0, 7919), (3, 104729)) t(off, m) GROUP BY 1, 2, 3, 4""")
cte("ready", """SELECT species_key, y AS known_yes, n AS known_no, u AS unsure, ly AS lib_yes, ln_ AS lib_no, greatest(0, 5 - y - ly) AS need_yes, greatest(0, 3 - n - ln_) AS need_no FROM (SELECT s.species_key, count(*) FILTER (verdict = 'yes') AS y,
 count(*) FILTER (verdict = 'no') AS n, count(*) FILTER (verdict = 'unsure') AS u, any_value(CASE WHEN e % 2 = 0 THEN e % 7 ELSE 0 END)::BIGINT AS ly, any_value(CASE WHEN e % 2 = 0 THEN e % 4 ELSE 0 END)::BIGINT AS ln_
 FROM loc_spp s LEFT JOIN loc_checks c USING (species_key) GROUP BY 1)""")


def _placed(df, at="sec"):
    where = F.concat_ws(".", "recording_id", F.floor(F.col(at) / 864000).cast("string"))
    return df.withColumn("species_key", F.concat_ws(" ", "species_key", where))


def _local(spark, d):
    return _placed(tb.events(spark, d))


def _local_checks(spark, d):
    k = F.col("k")
    v = F.when(k % 11 == 0, "yes").when(k % 3 == 0, "no").when(k % 3 == 1, "unsure").otherwise("yes")
    return _local(spark, d).groupBy("recording_id", F.col("sec").cast("double").alias("start_s"), "species_key").agg(F.max_by(v, "event_id").alias("verdict"))


def _local_pool(spark, d):
    two = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(m).alias("m")) for o, m in ((0, 7919), (3, 104729))])
    x = _local(spark, d).withColumn("two", F.explode(two)).withColumn("start_s", (F.col("sec") + F.col("two.o")).cast("double"))
    return x.groupBy("recording_id", "start_s", (F.col("start_s") + 3).alias("end_s"), "species_key").agg(
        F.max(((F.col("event_id") * F.col("two.m")) % 1000 / 1000.0).cast("float")).alias("score"))


def _local_species(spark, d):
    return _local(spark, d).groupBy("species_key").agg(F.min("event_id").alias("e"))


def _local_library(spark, d):
    return _local_species(spark, d).where("e % 2 = 0").select("species_key", (F.col("e") % 7).alias("lib_yes"), (F.col("e") % 4).alias("lib_no"))


@query("E4_readiness", """SELECT species_key, known_yes, known_no, unsure, lib_yes, lib_no, need_yes, need_no, need_yes = 0 AND need_no = 0 AS ready, lib_yes >= 5 AND lib_no >= 3 AS covered,
 round((least(known_yes + lib_yes, 5) + least(known_no + lib_no, 3)) / 8, 6) AS progress FROM ready""")
def e4(spark, d):
    return cb.readiness(_local_checks(spark, d), _local_species(spark, d), _local_library(spark, d)).select(
        "species_key", *big("known_yes", "known_no", "unsure", "lib_yes", "lib_no", "need_yes", "need_no"), "ready", "covered", *r6("progress"))


@query("E5_next_to_check", """SELECT species_key, recording_id, start_s FROM (SELECT p.*, row_number() OVER (PARTITION BY species_key ORDER BY score, CAST('0x' || substr(md5(recording_id || ':' || CAST(start_s AS BIGINT)), 1, 8) AS BIGINT), recording_id, start_s) AS ord,
 count(*) OVER (PARTITION BY species_key) AS m FROM loc_pool p WHERE (recording_id, start_s, species_key) NOT IN (SELECT (recording_id, start_s, species_key) FROM loc_checks)) JOIN (SELECT *, 4 - (known_yes + known_no + unsure) % 5 AS f,
 known_yes + known_no + unsure AS n FROM ready) USING (species_key) WHERE ord = CASE WHEN need_yes > 0 THEN m WHEN need_no > 0 THEN 1 WHEN floor(m * (f + 1) / 5 + 1e-9) > floor(m * f / 5 + 1e-9)
 THEN floor(m * f / 5 + 1e-9) + 1 + n % (floor(m * (f + 1) / 5 + 1e-9) - floor(m * f / 5 + 1e-9))::BIGINT ELSE m END""")
def e5(spark, d):
    return cb.next_to_check(_local_pool(spark, d), _local_checks(spark, d), _local_species(spark, d), _local_library(spark, d)).select("species_key", "recording_id", "start_s")


@query("E6_E17_typical_fit")
def e6(spark, d):
    """The logistic fit of truth on the pool's scores (iterative: no SQL; tested against numpy)."""
    pts, _ = cb.typical_fit(tb.pool(spark, d), tb.annotations(spark, d), BUCKET)
    a, b, cov = cb.platt(pts)
    return pts.agg(F.sum("w").alias("n")).select(F.round(F.lit(a), 5).alias("a"), F.round(F.lit(b), 5).alias("b"), "n")


@query("E17_real_share_by_rank", """SELECT rank, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = p.recording_id AND a.species_key = p.species_key AND least(a.end_s, p.end_s) - greatest(a.start_s, p.start_s) >= 0.5)
 THEN 1.0 ELSE 0 END), 6) AS real_share FROM pool p GROUP BY 1""")
def e17(spark, d):
    return cb.typical_fit(tb.pool(spark, d), tb.annotations(spark, d), BUCKET)[1].select(*big("rank", "n"), *r6("real_share"))


@query("E7_calibration")
def e7(spark, d):
    """Per-species chance of being real after answers (iterative: no SQL; tested against numpy)."""
    c = cb.calibration(tb.pool(spark, d), tb.checks(spark, d), (1.137, -0.527))
    return c["pool"].groupBy("species_key").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.max("off").alias("offset")).select("species_key", "n", *r6("p", "offset"))


cte("rt", "SELECT *, row_number() OVER w AS kept, sum(p) OVER w AS cum, count(*) OVER () AS n, sum(p) OVER () AS total FROM pp WINDOW w AS (ORDER BY score DESC, species_key, recording_id, start_s ROWS UNBOUNDED PRECEDING)")
cte("rtab", "SELECT score AS floor_, kept, cum, cum / total AS recall, 100 * (1 - cum / kept) AS fp100 FROM rt WHERE kept - 1 IN (SELECT (j * (n - 1)) // 99 FROM range(0, 100) t(j))")


def _table(spark, d):
    return cb.recall_table(_p(tb.pool(spark, d)), 100)


@query("E8_recall_table", "SELECT round(floor_, 6) AS floor, kept, round(cum, 4) AS expected_real, round(recall, 6) AS recall, round(fp100, 4) AS false_per_100 FROM rtab")
def e8(spark, d):
    return _table(spark, d).select(*r6("floor"), *big("kept"), F.round("expected_real", 4).alias("expected_real"), *r6("recall"), F.round("false_per_100", 4).alias("false_per_100"))


@query("E9_floor_for_recall", "SELECT round(floor_, 6) AS floor, kept, round(recall, 6) AS recall FROM rtab WHERE recall >= 0.8 ORDER BY kept LIMIT 1")
def e9(spark, d):
    return cb.floor_for_recall(_table(spark, d), 0.8).select(*r6("floor"), *big("kept"), *r6("recall"))


@query("E10_E11_recall_band")
def e10(spark, d):
    """The band over drawn calibrations on a grid of recalls (driver-drawn 2-vectors: no SQL; tested against numpy)."""
    c = cb.calibration(tb.pool(spark, d), tb.checks(spark, d), (1.137, -0.527))
    return cb.recall_band(c, [0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99], draws=200)


cte("ech", """SELECT recording_id, species_key, block, p, row_number() OVER (PARTITION BY recording_id, species_key, block ORDER BY score DESC, start_s) AS i FROM (SELECT *, floor(start_s / 259200)::BIGINT AS block FROM pp)""")


@query("E12_expected_checks", """SELECT recording_id, species_key, block, round(1 + coalesce(max(q1) FILTER (i = 2), 0) + coalesce(max(q1) FILTER (i = 3), 0) + coalesce(max(q1) FILTER (i = 4), 0) + coalesce(max(q1) FILTER (i = 5), 0), 6) AS checks FROM (
 SELECT *, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY recording_id, species_key, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS q1 FROM ech WHERE i <= 5) GROUP BY 1, 2, 3""")
def e12(spark, d):
    return cb.expected_checks(_p(tb.pool(spark, d)), "activity", 259200.0, 1, 5).select("recording_id", "species_key", *big("block"), *r6("checks"))


@query("E12_estimate_protocol", """SELECT count(*) AS units, round(sum(c))::BIGINT AS checks, floor(sum(c) * 5.6)::BIGINT AS answers_lo, floor(sum(c) * 8.4 * 1.2)::BIGINT AS answers_hi FROM (SELECT recording_id, species_key, sum(q) AS c FROM (
 SELECT recording_id, species_key, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY recording_id, species_key ORDER BY score DESC, start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS q FROM pp) GROUP BY 1, 2)""")
def e12b(spark, d):
    """No give-up rule: the running product over whole groups."""
    return cb.estimate_protocol(cb.expected_checks(_p(tb.pool(spark, d)), "presence", 300.0, 1, 0))


@query("E12_several_confirmations", """SELECT recording_id, species_key, round(sum(d0 + d1 + d2), 6) AS checks FROM (WITH RECURSIVE o AS (
 SELECT *, row_number() OVER (PARTITION BY recording_id, species_key ORDER BY score DESC, p DESC, start_s) AS i FROM pp), w AS (
 SELECT recording_id, species_key, i, p, 1.0::DOUBLE AS d0, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS d2 FROM o WHERE i = 1 UNION ALL
 SELECT o.recording_id, o.species_key, o.i, o.p, d0 * (1 - w.p), d1 * (1 - w.p) + d0 * w.p, d2 * (1 - w.p) + d1 * w.p FROM w JOIN o ON o.recording_id = w.recording_id AND o.species_key = w.species_key AND o.i = w.i + 1)
 SELECT * FROM w) GROUP BY 1, 2""")
def e12c(spark, d):
    return cb.expected_checks(_p(tb.pool(spark, d)), "presence", 300.0, 3, 0).select("recording_id", "species_key", *r6("checks"))


@query("E12_every_call", "SELECT count(*) AS units, count(*) AS checks, floor(count(*) * 5.6)::BIGINT AS answers_lo, floor(count(*) * 8.4 * 1.2)::BIGINT AS answers_hi FROM pp")
def e12d(spark, d):
    return cb.estimate_protocol(cb.expected_checks(_p(tb.pool(spark, d)), "every_call"), "every_call")


cte("kept", """SELECT p.* FROM pool p JOIN esp e USING (species_key) WHERE e.plausible AND e.idx <> 8 AND (p.score >= 0.7 OR (p.recording_id, p.start_s, p.species_key) IN (SELECT (recording_id, start_s, species_key) FROM checks))""")


def _kept(spark, d):
    return cb.kept_candidates(tb.pool(spark, d), _species(spark, d), tb.checks(spark, d), 0.7)


@query("E13_kept_candidates", "SELECT recording_id, start_s, species_key, round(score, 6) AS score FROM kept")
def e13(spark, d):
    return _kept(spark, d).select("recording_id", "start_s", "species_key", *r6("score"))


cte("loc_kept", "SELECT * FROM loc_pool p WHERE score >= 0.7 OR (recording_id, start_s, species_key) IN (SELECT (recording_id, start_s, species_key) FROM loc_checks)")
cte("loc_ann", "SELECT * REPLACE (species_key || ' ' || recording_id || '.' || CAST(floor(start_s / 864000) AS BIGINT) AS species_key) FROM e_ann")
cte("own_refs", "SELECT k.species_key, k.recording_id, k.start_s, k.end_s FROM loc_kept k JOIN loc_checks c USING (recording_id, start_s, species_key) WHERE verdict = 'yes'")


@query("E14_reference_picks", """SELECT species_key, recording_id, start_s, kind, greatest(0.0, start_s - 0.5) AS source_start_s FROM (SELECT *, 'answer' AS kind FROM own_refs UNION ALL SELECT b.species_key, recording_id, start_s, end_s, 'box' FROM (
 SELECT *, row_number() OVER (PARTITION BY species_key ORDER BY abs(end_s - start_s - 2.5), recording_id, start_s, box_id) AS i FROM loc_ann WHERE species_key IN (SELECT species_key FROM loc_kept)) b
 LEFT JOIN (SELECT species_key, count(*) AS have FROM own_refs GROUP BY 1) h USING (species_key) WHERE i <= 5 - coalesce(have, 0))""")
def e14(spark, d):
    sp = _local_species(spark, d).select("species_key", F.lit(False).alias("unexpected"), F.lit(True).alias("include"), F.lit("named").alias("name"), F.lit(False).alias("researcher"))
    checks = _local_checks(spark, d)
    cand = cb.kept_candidates(_local_pool(spark, d), sp, checks, 0.7)
    return cb.reference_picks(cand, checks, _placed(tb.annotations(spark, d), "start_s")).select("species_key", "recording_id", "start_s", "kind", "source_start_s")


@query("E15_few_detections", "SELECT species_key, plausible AND detections < 700 AS researcher FROM esp")
def e15(spark, d):
    return cb.few_detections(_species(spark, d), 700).select("species_key", "researcher")


@query("E16_strongest_examples", """SELECT species_key, recording_id, start_s, place FROM (SELECT p.*, row_number() OVER (PARTITION BY species_key ORDER BY score DESC, recording_id, start_s) AS place FROM pool p JOIN checks c
 USING (recording_id, start_s, species_key) WHERE verdict = 'yes') WHERE place <= 3""")
def e16(spark, d):
    return cb.strongest_examples(tb.pool(spark, d), tb.checks(spark, d)).select("species_key", "recording_id", "start_s", *big("place"))
