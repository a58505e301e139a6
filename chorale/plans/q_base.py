"""Queries of grids, intervals, alignment, the index, contracts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import schemas
from chorale.functions import clock, names
from chorale.operators import align as al
from chorale.operators import index as ix
from chorale.operators import intervals as iv
from chorale.operators import runs as rn
from chorale.operators import setups
from chorale.operators.curves import fbeta
from chorale.plans import testbed as tb
from chorale.plans.registry import big, cte, query, r6

BUCKET, BLOCK = 21600.0, 21600.0 * 16
REC = ["recording_id"]
OV = "least(a.end_s, w.end_s) - greatest(a.start_s, w.start_s)"
S1 = f"({OV} > 0 AND {OV} >= least(0.5, a.end_s - a.start_s) - 1e-9)"


# ------------------------------------------------------------------ grids and chunks
@query("G1_window_starts", """SELECT recording_id, (i * 21600)::DOUBLE AS start_s, (i * 21600 + 32400)::DOUBLE AS end_s FROM e_rec, range(0, 200) t(i)
 WHERE i < floor((2592000 - 32400) / 21600) + 1""")
def g1(spark, d):
    return iv.window_starts(tb.recordings(spark, d), 32400.0, 21600.0)


@query("G2_label_windows", f"SELECT DISTINCT w.run_id, w.recording_id, w.start_s, a.species_key FROM e_win w JOIN e_ann a ON a.recording_id = w.recording_id AND {S1}")
def g2(spark, d):
    w = tb.score_windows(spark, d).drop("scores")
    return al.label_windows(w, tb.annotations(spark, d), BUCKET, ix.WIN)


@query("G2_unknown_species_guard", "SELECT count(*) AS unknown FROM e_ann WHERE species_key NOT IN (SELECT species_key FROM spp WHERE idx < 8)")
def g2b(spark, d):
    return al.unknown_labels(tb.annotations(spark, d), tb.species(spark, d).where("idx < 8")).agg(F.count(F.lit(1)).alias("unknown"))


cte("proj", """SELECT x.run_id, x.recording_id, x.species_key, (i * 14400)::DOUBLE AS start_s, max(x.score) AS score FROM e_score x JOIN range(0, 180) t(i)
 ON i * 14400 < x.end_s AND i * 14400 + 14400 > x.start_s GROUP BY 1, 2, 3, 4""")


@query("G3_project_scores", "SELECT run_id, recording_id, species_key, start_s, round(score, 6) AS score FROM proj")
def g3(spark, d):
    return al.project_scores(tb.scored(spark, d), tb.recordings(spark, d), 14400.0, 14400.0).select(
        "run_id", "recording_id", "species_key", "start_s", *r6("score"))


@query("G4_all_chunks", """SELECT recording_id, (i * 50000)::DOUBLE AS start_s, CASE WHEN i = 51 THEN 2592000.0 ELSE (i + 1) * 50000 END::DOUBLE AS end_s FROM e_rec, range(0, 52) t(i)""")
def g4(spark, d):
    return iv.all_chunks(tb.recordings(spark, d), 50000.0).select("recording_id", "start_s", "end_s")


@query("G5_chunks_touched", """SELECT box_id, (c * 43200)::DOUBLE AS chunk FROM e_ann, range(0, 70) t(c) WHERE c BETWEEN floor(start_s / 43200) AND floor(greatest(start_s, end_s - 1e-6) / 43200)""")
def g5(spark, d):
    return iv.chunks_touched(tb.annotations(spark, d), 43200.0).select("box_id", "chunk")


def islands_sql(src: str, keys: str, tol: str = "1e-6") -> str:
    return f"""SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach + {tol} THEN 1 ELSE 0 END)
 OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src})) GROUP BY {keys}, g"""


cte("closedc", "SELECT * FROM chunks WHERE state = 'closed'")
cte("cover", islands_sql("closedc", "recording_id"))


@query("G6_merge_spans", f"SELECT * FROM cover UNION ALL SELECT * FROM ({islands_sql('e_ann', 'recording_id')})")
def g6(spark, d):
    c = iv.merge_spans(tb.label_chunks(spark, d).where("state = 'closed'"), REC, BLOCK)
    return c.unionByName(iv.merge_spans(tb.annotations(spark, d), REC, BLOCK))


def _coverage(spark, d):
    return iv.merge_spans(tb.label_chunks(spark, d).where("state = 'closed'"), REC, BLOCK)


@query("G7_within", """SELECT w.run_id, w.recording_id, w.start_s FROM e_win w ASOF JOIN cover c ON w.recording_id = c.recording_id AND w.start_s >= c.start_s WHERE w.end_s <= c.end_s + 1e-6""")
def g7(spark, d):
    w = tb.score_windows(spark, d).drop("scores")
    return iv.within(w, _coverage(spark, d), 43200.0 * 4).select(*ix.WIN)


@query("G8_within_or_last", """SELECT w.run_id, w.recording_id, w.start_s FROM (SELECT * FROM e_win UNION ALL SELECT 'late', recording_id, 2592000 - 3600, 2592000 + 18000 FROM e_rec) w ASOF JOIN cover c
 ON w.recording_id = c.recording_id AND w.start_s >= c.start_s WHERE c.end_s >= 2592000 - 1e-6 OR w.end_s <= c.end_s + 1e-6""")
def g8(spark, d):
    r = tb.recordings(spark, d)
    late = r.select(F.lit("late").alias("run_id"), "recording_id", (F.col("duration_s") - 3600).alias("start_s"), (F.col("duration_s") + 18000).alias("end_s"))
    w = tb.score_windows(spark, d).drop("scores").unionByName(late)
    return iv.within_or_last(w, _coverage(spark, d), r, 43200.0 * 4).select(*ix.WIN)


@query("G9_truth_blocks", "SELECT recording_id, box_id, species_key FROM e_ann WHERE end_s > 864000 AND start_s < 1000000")
def g9(spark, d):
    return iv.meeting(tb.annotations(spark, d), 864000.0, 1000000.0).select("recording_id", "box_id", "species_key")


cte("mr", """SELECT run_id, recording_id, start_s, end_s, species_key, score, CASE WHEN lag(species_key) OVER w IS DISTINCT FROM species_key OR start_s > lag(end_s) OVER w + 1e-6 THEN 1 ELSE 0 END AS new
 FROM e_det WHERE above AND rank = 1 WINDOW w AS (PARTITION BY run_id, recording_id ORDER BY start_s, species_key)""")


@query("G10_merge_runs", """SELECT run_id, recording_id, species_key, min(start_s) AS start_s, max(end_s) AS end_s, round(max(score), 6) AS score_raw FROM (
 SELECT *, sum(new) OVER (PARTITION BY run_id, recording_id ORDER BY start_s, species_key ROWS UNBOUNDED PRECEDING) AS g FROM mr) GROUP BY 1, 2, 3, g""")
def g10(spark, d):
    b = tb.thresholded(spark, d).where("above and rank_in_window = 1").select("run_id", "recording_id", "start_s", "end_s", "species_key", "score_raw")
    return iv.merge_runs(b, ["run_id", "recording_id"], BLOCK).select("run_id", "recording_id", "species_key", "start_s", "end_s", *r6("score_raw"))


cte("sr", """SELECT *, sum(CASE WHEN start_s - prev > w * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, recording_id, species_key ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT d.*, r.w, lag(start_s) OVER (PARTITION BY d.run_id, recording_id, species_key ORDER BY start_s) AS prev FROM e_det d JOIN runs r USING (run_id) WHERE above)""")
def _hop():
    return F.when(F.col("run_id") == "runA", 21600.0).otherwise(32400.0)


def _runs(spark, d):
    return iv.score_runs(tb.thresholded(spark, d).where("above").select("run_id", "recording_id", "start_s", "end_s", "species_key"), ["run_id", "recording_id"], _hop(), BLOCK)


@query("G11_score_runs", "SELECT run_id, recording_id, species_key, start_s, run::BIGINT AS run, (start_s + end_s) / 2 AS center_s FROM sr")
def g11(spark, d):
    return _runs(spark, d).select("run_id", "recording_id", "species_key", "start_s", *big("run"), "center_s")


@query("G12_run_correct", """SELECT run_id, recording_id, species_key, run::BIGINT AS run, s AS start_s, e AS end_s, n AS windows, EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = x.recording_id
 AND a.species_key = x.species_key AND a.start_s < x.e AND a.end_s > x.s) AS correct FROM (SELECT run_id, recording_id, species_key, run, min(start_s) - any_value(w) / 2 AS s,
 max(end_s) + any_value(w) / 2 AS e, count(*) AS n FROM sr GROUP BY 1, 2, 3, 4) x""")
def g12(spark, d):
    reach = iv.run_reach(_runs(spark, d), ["run_id", "recording_id"], _hop())
    return iv.run_correct(reach, tb.annotations(spark, d), BUCKET, ["run_id", "recording_id"]).select(
        "run_id", "recording_id", "species_key", *big("run", "windows"), "start_s", "end_s", "correct")


@query("G13_pack_rows")
def g13(spark, d):
    """Lanes of the truth boxes, one view per recording and day."""
    b = tb.annotations(spark, d).select("recording_id", F.floor(F.col("start_s") / 86400).alias("view"), "start_s", "end_s", "species_key", F.col("box_id").cast("long").alias("tie"))
    return iv.pack_rows(b, ["recording_id", "view"], "recording_id string, view long, start_s double, end_s double, species_key string, tie long, row long")


@query("G14_window_grid", """SELECT box_id, (i * 21600)::DOUBLE AS start_s FROM e_ann, range(0, 130) t(i) WHERE i >= floor(start_s / 21600) AND i * 21600 < end_s - 1e-9""")
def g14(spark, d):
    s = tb.annotations(spark, d).select("box_id", F.col("start_s").alias("t0"), F.col("end_s").alias("t1"))
    return iv.window_grid(s, 21600.0).select("box_id", "start_s")


@query("G15_window_at", "SELECT run_id, recording_id, max(start_s) AS start_s, arg_max(end_s, start_s) AS end_s FROM e_det WHERE start_s <= 1234567 AND end_s > 1234567 GROUP BY 1, 2")
def g15(spark, d):
    from chorale.operators.explore import window_at
    return window_at(tb.detections(spark, d), ["run_id", "recording_id"], F.lit(1234567.0))


EOV = "least(a.end_s, w.end_s) - greatest(a.start_s, w.start_s)"
cte("prac", """SELECT recording_id, start_s + 900 AS start_s, end_s - 900 AS end_s, CASE WHEN CAST(box_id AS BIGINT) % 5 = 0 THEN 'Turdus merula' ELSE species_key END AS species_key, 'm' || box_id AS box_id
 FROM e_ann WHERE CAST(box_id AS BIGINT) % 3 <> 0""")
cte("prac_pairs", f"""SELECT w.box_id, w.species_key, a.box_id AS mine_id, a.species_key AS mine_key, a.start_s AS ms FROM e_ann w JOIN prac a ON a.recording_id = w.recording_id
 AND {EOV} > 0 AND {EOV} >= least(0.5, a.end_s - a.start_s, w.end_s - w.start_s) - 1e-9""")


def _practice(spark, d):
    n = F.col("box_id").cast("long")
    mine = tb.annotations(spark, d).where(n % 3 != 0).select(
        "recording_id", (F.col("start_s") + 900).alias("start_s"), (F.col("end_s") - 900).alias("end_s"),
        F.when(n % 5 == 0, "Turdus merula").otherwise(F.col("species_key")).alias("species_key"), F.concat(F.lit("m"), "box_id").alias("box_id"))
    return iv.compare_to_reference(mine, tb.annotations(spark, d), BUCKET)


@query("G16_compare_calls", """SELECT box_id, CASE WHEN sm THEN 'found' WHEN ot IS NOT NULL THEN 'named differently' ELSE 'missed' END AS outcome, CASE WHEN sm THEN species_key ELSE ot END AS yours FROM e_ann
 LEFT JOIN (SELECT box_id, bool_or(mine_key = species_key) AS sm, arg_min(mine_key, (ms, mine_id)) FILTER (mine_key <> species_key) AS ot FROM prac_pairs GROUP BY 1) USING (box_id)""")
def g16(spark, d):
    return _practice(spark, d)[0].select("box_id", "outcome", "yours")


@query("G16_compare_extra", "SELECT box_id, species_key FROM prac WHERE box_id NOT IN (SELECT mine_id FROM prac_pairs WHERE mine_key = species_key)")
def g16b(spark, d):
    return _practice(spark, d)[1].select("box_id", "species_key")


@query("G17_union_length", f"SELECT recording_id, round(sum(end_s - start_s), 6) AS covered_s FROM ({islands_sql('e_ann', 'recording_id', '0')}) GROUP BY 1")
def g17(spark, d):
    return iv.union_length(tb.annotations(spark, d), REC, BLOCK).select("recording_id", *r6("covered_s"))


# ------------------------------------------------------------------ index
cte("matrix", """SELECT w.run_id, w.recording_id, w.start_s, s.species_key, s.idx, coalesce(x.score, 0.0) AS score, row_number() OVER (PARTITION BY w.run_id, w.recording_id, w.start_s
 ORDER BY coalesce(x.score, 0) DESC, s.idx) AS rank FROM e_win w CROSS JOIN spp s LEFT JOIN e_score x USING (run_id, recording_id, start_s, species_key)""")


@query("H1_derive_detections", "SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score_raw, rank AS rank_in_window FROM matrix WHERE rank <= 2 OR score >= 0.9 OR (idx IN (3, 6) AND score >= 0.2)")
def h1(spark, d):
    det = ix.derive_detections(tb.score_windows(spark, d), list(tb.SPECIES), 2, 0.9, ["Engine", "Sitta canadensis"], 0.2)
    return det.select("run_id", "recording_id", "start_s", "species_key", *r6("score_raw"), *big("rank_in_window"))


@query("H2_always_keys", "SELECT species_key FROM spp WHERE coalesce(tier, 3) <= 2 UNION SELECT species_key FROM e_ann")
def h2(spark, d):
    return ix.always_keys(tb.species(spark, d), tb.annotations(spark, d))


@query("H3_index_with_occurrence", """SELECT run_id, recording_id, start_s, species_key, round(o.occ, 6) AS occ_score, coalesce(o.occ < 0.3, false) AS suppressed FROM matrix JOIN e_rec USING (recording_id)
 LEFT JOIN (SELECT site, species_key, (idx + CAST(substr(site, 5) AS INTEGER)) / 20.0 AS occ FROM spp, (SELECT DISTINCT site FROM e_rec) WHERE idx <> 2) o USING (site, species_key) WHERE rank <= 3 OR score >= 0.5""")
def h3(spark, d):
    det = ix.derive_detections(tb.score_windows(spark, d), list(tb.SPECIES), 3, 0.5)
    sites = tb.recordings(spark, d).select("recording_id", "site")
    occ = tb.species(spark, d).where("idx <> 2").select("species_key", "idx", F.explode(F.array(*[F.lit(f"site{i}") for i in range(5)])).alias("site"))
    occ = occ.select("site", "species_key", ((F.col("idx") + F.expr("substring(site, 5)").cast("int")) / 20.0).cast("float").alias("occ"))
    return ix.apply_occurrence(det.join(sites, "recording_id"), occ, ["site", "species_key"], 0.3).select(
        "run_id", "recording_id", "start_s", "species_key", *r6("occ_score"), "suppressed")


@query("H4_readout_floor", "SELECT run_id, recording_id, count(*) AS kept FROM matrix WHERE rank <= 2 OR (run_id = 'runA' AND score >= 0.01) GROUP BY 1, 2")
def h4(spark, d):
    """runA reads as softmax, runB as sigmoid (ranks only)."""
    sw = tb.score_windows(spark, d)
    parts = [ix.derive_detections(sw.where(F.col("run_id") == r), list(tb.SPECIES), 2, ix.index_floor(t)) for r, t in (("runA", "softmax"), ("runB", "sigmoid"))]
    return parts[0].unionByName(parts[1]).groupBy("run_id", "recording_id").agg(F.count(F.lit(1)).alias("kept"))


@query("B15_index_crosscheck", "SELECT 0::BIGINT AS differences")
def b15(spark, d):
    """The array-side index equals one ranked over the exploded matrix."""
    from pyspark.sql import Window
    sw = tb.score_windows(spark, d)
    a = ix.derive_detections(sw, list(tb.SPECIES), 2, 0.9).select(*ix.WIN, "species_key", "score_raw", "rank_in_window")
    w = Window.partitionBy(*ix.WIN).orderBy(F.col("score").desc(), "class_idx")
    b = ix.explode_scores(sw, list(tb.SPECIES)).withColumn("rank_in_window", F.row_number().over(w)).where(
        (F.col("rank_in_window") <= 2) | (F.col("score") >= 0.9)).select(*ix.WIN, "species_key", F.col("score").alias("score_raw"), "rank_in_window")
    return rn.index_differences(a, b).agg(F.count(F.lit(1)).alias("differences"))


@query("B15_planted_differences", """SELECT run_id, recording_id, sum(rows)::BIGINT AS index_rows, sum(oi)::BIGINT AS only_index, sum(om)::BIGINT AS only_matrix,
 count(*) FILTER (ti > 0) AS windows_index, count(*) FILTER (tm > 0) AS windows_matrix, count(*) FILTER (bi > 0) AS muddy_index, count(*) FILTER (bm > 0) AS muddy_matrix,
 round(max(abs(CASE WHEN ti > 0 THEN bi / ti ELSE 0 END - CASE WHEN tm > 0 THEN bm / tm ELSE 0 END)), 6) AS mass_gap,
 sum(oi) + sum(om) = 0 AND count(*) FILTER ((ti > 0) <> (tm > 0)) = 0 AND count(*) FILTER (bi > 0) = count(*) FILTER (bm > 0) AS agrees FROM (
 SELECT run_id, recording_id, start_s, count(*) FILTER (i) AS rows, count(*) FILTER (i AND s <> score) AS oi, count(*) FILTER (m AND (NOT i OR s <> score)) AS om,
 coalesce(sum(s) FILTER (i AND s >= 0.4), 0) AS ti, coalesce(sum(s) FILTER (i AND s >= 0.4 AND idx IN (2, 4, 8)), 0) AS bi,
 coalesce(sum(score) FILTER (score >= 0.4), 0) AS tm, coalesce(sum(score) FILTER (score >= 0.4 AND idx IN (2, 4, 8)), 0) AS bm FROM (
 SELECT *, m AND NOT (CAST(substr(recording_id, 2) AS INTEGER) % 7 = 3 AND rank = 2) AS i, CASE WHEN CAST(substr(recording_id, 2) AS INTEGER) % 7 = 5 AND start_s % 86400 = 0
 THEN CAST(CAST(score - 0.25 AS FLOAT) AS DOUBLE) ELSE score END AS s FROM (SELECT *, rank <= 2 OR score >= 0.4 AS m FROM matrix)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def b15_planted(spark, d):
    """A stored index that has lost rows in some recordings and holds lower scores in others."""
    from chorale.operators.crosscheck import cross_check
    sw, vocab = tb.score_windows(spark, d), list(tb.SPECIES)
    rebuilt = ix.derive_detections(sw, vocab, 2, 0.4)
    r = F.expr("substring(recording_id, 2)").cast("int") % 7
    stored = rebuilt.where((r != 3) | (F.col("rank_in_window") != 2)).withColumn(
        "score_raw", F.when((r == 5) & (F.col("start_s") % 86400 == 0), (F.col("score_raw") - F.lit(0.25)).cast("float")).otherwise(F.col("score_raw")))
    found = cross_check(stored, rebuilt, sw, vocab, [vocab[i] for i in (2, 4, 8)], 0.4)
    return found.select("run_id", "recording_id", *big("index_rows", "only_index", "only_matrix", "windows_index", "windows_matrix", "muddy_index", "muddy_matrix"),
                        *r6("mass_gap"), "agrees")


# ------------------------------------------------------------------ alignment
@query("I1_eval_species", "SELECT DISTINCT species_key FROM e_ann JOIN e_rec USING (recording_id) WHERE labelled")
def i1(spark, d):
    return tb.annotations(spark, d).join(tb.recordings(spark, d).where("labelled"), "recording_id", "left_semi").select("species_key").distinct()


@query("I2_align_native", "SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score, y_true::BIGINT AS y_true FROM e_al")
def i2(spark, d):
    return tb.aligned(spark, d).select(*ix.WIN, "species_key", *r6("score"), *big("y_true"))


SHARED = """SELECT r.run_id, e.recording_id, (i * 14400)::DOUBLE AS start_s, s.species_key, round(coalesce(p.score, 0), 6) AS score, CASE WHEN EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = e.recording_id
 AND a.species_key = s.species_key AND least(a.end_s, i * 14400 + 14400) - greatest(a.start_s, i * 14400) >= least(0.5, a.end_s - a.start_s) - 1e-9 AND least(a.end_s, i * 14400 + 14400) > greatest(a.start_s, i * 14400))
 THEN 1 ELSE 0 END::BIGINT AS y_true FROM e_rec e CROSS JOIN runs r CROSS JOIN spp s CROSS JOIN range(0, 180) t(i)
 LEFT JOIN proj p ON p.run_id = r.run_id AND p.recording_id = e.recording_id AND p.species_key = s.species_key AND p.start_s = i * 14400"""


@query("I2_align_shared_grid", SHARED)
def i2s(spark, d):
    r = tb.recordings(spark, d)
    p = al.project_scores(tb.scored(spark, d), r, 14400.0, 14400.0)
    dense = al.densify(p, r, list(tb.RUNS), list(tb.SPECIES), 14400.0, 14400.0)
    return al.label_long(dense, tb.annotations(spark, d), BUCKET, ix.WIN).select(*ix.WIN, "species_key", *r6("score"), *big("y_true"))


@query("I3_align_run_closed_time", """SELECT a.run_id, a.recording_id, a.start_s, a.species_key, a.y_true::BIGINT AS y_true FROM e_al a ASOF JOIN cover c ON a.recording_id = c.recording_id AND a.start_s >= c.start_s
 WHERE c.end_s >= 2592000 - 1e-6 OR a.end_s <= c.end_s + 1e-6""")
def i3(spark, d):
    r = tb.recordings(spark, d)
    t = al.truth_from_set(tb.label_chunks(spark, d), tb.label_boxes(spark, d), r, tb.CHUNK_S)
    return al.closed_time_only(tb.aligned(spark, d), t["coverage"], t["complete"], r, 43200.0 * 4).select(*ix.WIN, "species_key", *big("y_true"))


@query("I3_align_meta", """SELECT run_id, count(DISTINCT recording_id) AS n_recordings, count(DISTINCT (recording_id, start_s)) AS n_windows, count(*) AS n_pairs, sum(y_true)::BIGINT AS n_positive,
 count(DISTINCT species_key) AS n_species FROM e_al GROUP BY 1""")
def i3m(spark, d):
    return al.align_meta(tb.aligned(spark, d), ["run_id"]).select("run_id", *big("n_recordings", "n_windows", "n_pairs", "n_positive", "n_species"))


cte("truth_boxes", """SELECT b.* FROM boxes b WHERE EXISTS (SELECT 1 FROM closedc c WHERE c.recording_id = b.recording_id AND c.start_s / 43200 BETWEEN floor(b.start_s / 43200)
 AND floor(greatest(b.start_s, b.end_s - 1e-6) / 43200))""")


def _truth(spark, d):
    return al.truth_from_set(tb.label_chunks(spark, d), tb.label_boxes(spark, d), tb.recordings(spark, d), tb.CHUNK_S)


@query("I4_truth_annotations", "SELECT box_id, recording_id, species_key FROM truth_boxes WHERE species_key <> 'unknown bird'")
def i4(spark, d):
    return _truth(spark, d)["annotations"].select("box_id", "recording_id", "species_key")


@query("I4_truth_covered", "SELECT recording_id, sum(end_s - start_s) AS covered_s, (SELECT count(*) FROM truth_boxes WHERE species_key = 'unknown bird') AS n_unknown FROM closedc GROUP BY 1")
def i4b(spark, d):
    t = _truth(spark, d)
    n = t["unknown"].agg(F.count(F.lit(1))).scalar()
    return t["covered"].select("recording_id", "covered_s", n.alias("n_unknown"))


@query("I4_imported_truth", "SELECT recording_id, 0.0::DOUBLE AS start_s, duration_s AS end_s FROM e_rec WHERE labelled")
def i4c(spark, d):
    return al.imported_truth(tb.recordings(spark, d), tb.annotations(spark, d))["coverage"]


@query("I5_all_boxes", "SELECT recording_id, count(*) AS boxes, count(*) FILTER (assisted) AS assisted FROM boxes GROUP BY 1")
def i5(spark, d):
    return tb.label_boxes(spark, d).groupBy("recording_id").agg(F.count(F.lit(1)).alias("boxes"), F.count_if("assisted").alias("assisted"))


@query("I6_labelled_only", """SELECT w.run_id, w.recording_id, w.start_s, w.species_key FROM e_det w ASOF JOIN cover c ON w.recording_id = c.recording_id AND w.start_s >= c.start_s
 WHERE c.end_s >= 2592000 - 1e-6 OR w.end_s <= c.end_s + 1e-6""")
def i6(spark, d):
    return al.labelled_only(tb.detections(spark, d), _truth(spark, d), tb.recordings(spark, d), False, 43200.0 * 4).select(*ix.WIN, "species_key")


# ------------------------------------------------------------------ contracts and runs
def _dirty_det(spark, d):
    """Detections with violations planted by event arithmetic."""
    det = tb.detections(spark, d).drop("implausible")
    w = (F.col("start_s") / 10800).cast("long")
    return det.withColumn("score_raw", F.when(w % 7 == 0, F.col("score_raw") + 1).otherwise(F.col("score_raw"))).withColumn(
        "end_s", F.when(w % 11 == 0, F.col("start_s")).otherwise(F.col("end_s"))).withColumn("species_key", F.when(w % 13 == 0, None).otherwise(F.col("species_key")))


cte("dirty", """SELECT start_s, CASE WHEN w % 7 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN w % 11 = 0 THEN start_s ELSE end_s END AS end_s, CASE WHEN w % 13 = 0 THEN NULL ELSE species_key END AS species_key,
 rank FROM (SELECT *, CAST(start_s / 10800 AS BIGINT) AS w FROM e_det)""")


@query("B1_B4_validate_detections", """SELECT rule, n AS violations FROM (SELECT count(*) FILTER (species_key IS NULL) AS a, count(*) FILTER (end_s <= start_s) AS b, count(*) FILTER (score < 0 OR score > 1) AS c FROM dirty),
 LATERAL (VALUES ('null species_key', a), ('end_s <= start_s', b), ('score_raw outside [0, 1]', c)) t(rule, n)""")
def b4(spark, d):
    return schemas.violations(_dirty_det(spark, d), "detections").where("violations > 0").select("rule", *big("violations"))


@query("B2_validate_recordings", "SELECT 'recording_id is not unique' AS rule, count(*) AS violations FROM e_rec WHERE r % 4 = 0")
def b2(spark, d):
    r = tb.recordings(spark, d)
    twice = r.unionByName(r.where(F.expr("substring(recording_id, 2)").cast("long") % 4 == 0))
    return schemas.violations(twice, "recordings").where("violations > 0").select("rule", *big("violations"))


@query("B3_validate_annotations", "SELECT 'end_s <= start_s' AS rule, count(*) AS violations FROM e_ann WHERE CAST(box_id AS BIGINT) % 6 = 0")
def b3(spark, d):
    bad = tb.annotations(spark, d).withColumn("end_s", F.when(F.col("box_id").cast("long") % 6 == 0, F.col("start_s")).otherwise(F.col("end_s")))
    return schemas.violations(bad, "annotations").where("violations > 0").select("rule", *big("violations"))


def manifests(spark, d):
    """A run per (recording's site, event-derived readout): model names and transforms that collide on purpose."""
    s = tb.events(spark, d).select("recording_id", (F.col("r") % 5).alias("site"), "species_key").groupBy("site", "species_key").agg(
        F.count_distinct("recording_id").alias("n"))
    idx = F.element_at(F.create_map(*[x for i, v in enumerate(tb.SPECIES) for x in (F.lit(v), F.lit(i))]), F.col("species_key"))
    kinds = F.array(*[F.lit(x) for x in ("Softmax over classes", "per-class sigmoid", "  identity", "logits")])
    return s.select(F.concat(F.lit("run-"), F.lpad((F.col("site") * 100 + idx).cast("string"), 8, "0")).alias("run_id"),
                    F.concat(F.lit("m"), (idx % 3).cast("string")).alias("model_name"), F.col("site").cast("string").alias("model_version"),
                    F.element_at(kinds, idx % 4 + 1).alias("score_transform"), F.lit("ds").alias("dataset"), "n",
                    F.concat(F.lit("2024-01-"), F.lpad((idx + 1).cast("string"), 2, "0")).alias("created_utc"))


cte("man", """SELECT 'run-' || lpad(CAST(site * 100 + idx AS VARCHAR), 8, '0') AS run_id, 'm' || (idx % 3) AS model_name, CAST(site AS VARCHAR) AS model_version,
 ['Softmax over classes', 'per-class sigmoid', '  identity', 'logits'][idx % 4 + 1] AS score_transform, ['softmax', 'sigmoid', 'identity', ''][idx % 4 + 1] AS tok, n,
 '2024-01-' || lpad(CAST(idx + 1 AS VARCHAR), 2, '0') AS created_utc FROM (SELECT r % 5 AS site, species_key, count(DISTINCT recording_id) AS n FROM e_ev GROUP BY 1, 2) JOIN spp USING (species_key)""")


@query("B6_complete_runs", "SELECT run_id, created_utc FROM man WHERE n = (SELECT max(n) FROM man)")
def b6(spark, d):
    m = manifests(spark, d)
    top = m.agg(F.max("n").alias("n"))
    return m.join(top, "n", "left_semi").orderBy(F.col("created_utc").desc()).select("run_id", "created_utc")


@query("B6_scored_every_recording", "SELECT run_id, count(DISTINCT recording_id) AS scored FROM e_win GROUP BY 1")
def b6b(spark, d):
    return setups.complete_runs(tb.score_windows(spark, d), tb.recordings(spark, d), ["run_id"]).select("run_id", *big("scored"))


@query("B7_B8_identity", "SELECT run_id, tok AS readout, model_name || ' ' || model_version || ' ' || CASE WHEN tok = '' THEN 'unknown-readout' ELSE tok END AS identity FROM man")
def b8(spark, d):
    return rn.identity(manifests(spark, d)).select("run_id", "readout", "identity")


@query("B9_arm_labels", """SELECT run_id, CASE WHEN count(*) OVER (PARTITION BY l) > 1 THEN l || ' [' || right(run_id, 8) || ']' ELSE l END AS label FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY b) = 1 THEN b
 WHEN tok <> '' THEN b || ' (' || tok || ')' ELSE b || ' [' || right(run_id, 8) || ']' END AS l FROM (SELECT *, model_name || '-' || model_version AS b FROM man))""")
def b9(spark, d):
    return rn.arm_labels(manifests(spark, d)).select("run_id", "label")


@query("B10_across_window_comparable", "SELECT run_id, tok <> 'softmax' AS across_window_comparable FROM man")
def b10(spark, d):
    return rn.comparable(manifests(spark, d)).select("run_id", "across_window_comparable")


@query("B12_embedding_contract", """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'no scores' ELSE 'no embedding' END AS missing FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0
 EXCEPT SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'no scores' ELSE 'no embedding' END FROM embeddings WHERE vec_id % 77 = 0""")
def b12(spark, d):
    e = tb.table(spark, d, "embeddings")
    return rn.embedding_mismatch(e.where("vec_id % 7 <> 0"), e.where("vec_id % 11 <> 0"), ["vec_id"])


@query("B13_leakage_guard", "SELECT recording_id FROM e_rec WHERE r % 9 = 0")
def b13(spark, d):
    r = tb.recordings(spark, d)
    return rn.leaked(r, r.where(F.expr("substring(recording_id, 2)").cast("long") % 9 == 0)).select("recording_id")


@query("B14_refs", """SELECT ref, split_part(ref, '@', 1) AS name, TRY_CAST(nullif(regexp_extract(ref, '@v([0-9]+)$', 1), '') AS BIGINT) AS version, CASE WHEN ref = 'imported' THEN 'the imported annotations'
 WHEN regexp_matches(ref, '@v[0-9]+$') THEN split_part(ref, '@', 1) || ' v' || regexp_extract(ref, '@v([0-9]+)$', 1) ELSE split_part(ref, '@', 1) || ' (working copy)' END AS described
 FROM (SELECT DISTINCT CASE r % 3 WHEN 0 THEN 'imported' WHEN 1 THEN 'set' || r || '@v' || r ELSE 'set' || r || '@wab12' END AS ref FROM e_rec)""")
def b14(spark, d):
    r = F.expr("substring(recording_id, 2)")
    n = r.cast("long") % 3
    ref = F.when(n == 0, "imported").when(n == 1, F.concat(F.lit("set"), r, F.lit("@v"), r)).otherwise(F.concat(F.lit("set"), r, F.lit("@wab12")))
    return rn.describe_ref(tb.recordings(spark, d).select(ref.alias("ref")).distinct()).select("ref", "name", "version", "described")


@query("B14_working_ref")
def b14b(spark, d):
    return rn.content_ref(tb.label_boxes(spark, d), "night")


# ------------------------------------------------------------------ scalar functions
@query("F1_F2_F3_names", """SELECT DISTINCT p_type AS raw, upper(substr(x, 1, 1)) || substr(x, 2) AS key, regexp_matches(upper(substr(x, 1, 1)) || substr(x, 2), '^[A-Z][a-z]+ [a-z\\-]+( [a-z\\-]+)?$') AS species,
 split_part(upper(substr(x, 1, 1)) || substr(x, 2), ' ', 1) AS genus FROM (SELECT p_type, lower(regexp_replace(trim('  ' || p_type || '  '), '\\s+', ' ', 'g')) AS x FROM part)""")
def f1(spark, d):
    p = tb.table(spark, d, "part").select(F.col("p_type").alias("raw")).distinct()
    k = names.normalise_key(F.concat(F.lit("  "), "raw", F.lit("  ")))
    return p.withColumn("key", k).withColumn("species", names.is_species(F.col("key"))).withColumn("genus", names.genus(F.col("key")))


@query("F4_reference_links", "SELECT DISTINCT species_key, 'https://xeno-canto.org/species/' || replace(species_key, ' ', '-') AS url FROM e_ev")
def f4(spark, d):
    return tb.species(spark, d).select("species_key", names.xc_species_url(F.col("species_key")).alias("url"))


def _canonical(spark, d):
    """A species table from the data: key, common name, code (one species without)."""
    s = tb.species(spark, d)
    return s.select("species_key", F.concat(F.lit("Bird "), F.col("idx").cast("string")).alias("common_name"),
                    F.when(F.col("idx") != 5, F.concat(F.lower(F.substring("species_key", 1, 4)), F.col("idx").cast("string"))).otherwise("").alias("ebird_code"))


cte("canon", "SELECT species_key, 'Bird ' || idx AS common_name, CASE WHEN idx <> 5 THEN lower(substr(species_key, 1, 4)) || idx ELSE '' END AS ebird_code FROM spp")


@query("F5_map_codes", """SELECT code, min(species_key) AS species_key FROM (SELECT DISTINCT lower(substr(species_key, 1, 4)) || (k % 10) AS code FROM e_ev) c LEFT JOIN canon ON ebird_code = code GROUP BY 1""")
def f5(spark, d):
    labels = tb.events(spark, d).select(F.concat(F.lower(F.substring("species_key", 1, 4)), (F.col("k") % 10).cast("string")).alias("code")).distinct()
    good, bad = names.map_codes(labels, _canonical(spark, d))
    return good.unionByName(bad.withColumn("species_key", F.lit(None).cast("string")))


@query("F6_F7_vocabulary", """SELECT key AS species_key, count(*) AS labels FROM (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN species_key || '_Name ' || (k % 4) ELSE species_key || '_x' END AS label, CASE WHEN k % 2 = 0 THEN species_key
 ELSE upper(substr(species_key, 1, 1)) || lower(substr(species_key, 2)) || '_x' END AS key FROM e_ev) GROUP BY 1 HAVING count(*) > 1""")
def f7(spark, d):
    e = tb.events(spark, d).select(
        F.when(F.col("k") % 2 == 0, F.concat("species_key", F.lit("_Name "), (F.col("k") % 4).cast("string"))).otherwise(F.concat("species_key", F.lit("_x"))).alias("label"),
        (F.col("k") % 2 == 0).alias("split_common")).distinct()
    mapped, _ = names.map_scientific_names(e)
    return names.vocabulary_collisions(mapped).select("species_key", *big("labels"))


@query("F8_canonical", "SELECT species_key, common_name, ebird_code FROM canon")
def f8(spark, d):
    from chorale.sources.annotations import canonical_species
    raw = _canonical(spark, d).select(F.upper("species_key").alias("Scientific Name"), F.col("common_name").alias("Common Name"), F.col("ebird_code").alias("Species eBird Code"))
    return canonical_species(raw)


@query("F9_species_lookup", """SELECT name, arg_min(species_key, (p, species_key)) AS species_key FROM (SELECT lower(species_key) AS name, 0 AS p, species_key FROM canon UNION ALL SELECT lower(common_name), 1, species_key FROM canon
 UNION ALL SELECT lower(ebird_code), 2, species_key FROM canon WHERE ebird_code <> '') GROUP BY 1""")
def f9(spark, d):
    c = _canonical(spark, d)
    return names.species_lookup(c, c.where("ebird_code <> ''").withColumnRenamed("ebird_code", "code"))


@query("F10_looks_like_codes", "SELECT avg(CASE WHEN regexp_matches(trim(p_brand), '^[a-z]{4,6}\\d?$') THEN 1 ELSE 0 END) >= 0.8 AS codes FROM part")
def f10(spark, d):
    return names.looks_like_codes(tb.table(spark, d, "part").select(F.col("p_brand").alias("name")))


cte("nm", "SELECT DISTINCT 'src' || (event_id % 3) AS source, species_key, 'N' || (event_id % 3) || species_key AS common_name, event_id % 3 AS s FROM e_ev WHERE (event_id % 3 = 0) OR (k + event_id % 3) % 97 < 20")


def _name_entries(spark, d):
    s = F.col("event_id") % 3
    return tb.events(spark, d).where((s == 0) | ((F.col("k") + s) % 97 < 20)).select(
        F.concat(F.lit("src"), s.cast("string")).alias("source"), "species_key", F.concat(F.lit("N"), s.cast("string"), "species_key").alias("common_name")).distinct()


@query("F11_common_name_index", """SELECT species_key, arg_min(common_name, (-n, source, common_name)) AS common_name FROM nm JOIN (SELECT source, count(DISTINCT species_key) AS n FROM nm GROUP BY 1) USING (source)
 WHERE contains(species_key, ' ') GROUP BY 1""")
def f11(spark, d):
    return names.common_name_index(_name_entries(spark, d))


@query("F12_profile_names_first", "SELECT species_key, coalesce(c.common_name, n.common_name) AS common_name FROM (SELECT * FROM canon WHERE ebird_code <> '') c FULL JOIN (SELECT * FROM nm WHERE source = 'src0') n USING (species_key)")
def f12(spark, d):
    labels = _name_entries(spark, d).where("source = 'src0'").select("species_key", "common_name")
    return names.profile_first(_canonical(spark, d).where("ebird_code <> ''"), labels)


@query("F13_parse_timestamp", """SELECT DISTINCT stem, coalesce(strftime(TRY_CAST(nullif(regexp_extract(stem, '(?:^|[^0-9])([0-9]{8})[_T-]([0-9]{6})(?:[^0-9]|$)', 1), '')[1:4] || '-' || regexp_extract(stem, '([0-9]{8})[_T-][0-9]{6}', 1)[5:6] || '-'
 || regexp_extract(stem, '([0-9]{8})[_T-][0-9]{6}', 1)[7:8] || ' ' || regexp_extract(stem, '[0-9]{8}[_T-]([0-9]{6})', 1)[1:2] || ':' || regexp_extract(stem, '[0-9]{8}[_T-]([0-9]{6})', 1)[3:4] || ':'
 || regexp_extract(stem, '[0-9]{8}[_T-]([0-9]{6})', 1)[5:6] AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S'), CASE WHEN stem LIKE '5%' THEN strftime(make_timestamp((1500000000 + sec) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END, '') AS start_time
 FROM (SELECT sec, CASE sec % 3 WHEN 0 THEN 'SNE_' || (sec % 50) || '_201805' || lpad(CAST(sec % 33 AS VARCHAR), 2, '0') || '_05' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') || '02' WHEN 1 THEN upper(to_hex(1500000000 + sec)) ELSE 'site' || sec END AS stem FROM e_ev)""")
def f13(spark, d):
    s = F.col("sec")
    two = lambda n: F.lpad((s % n).cast("string"), 2, "0")
    stem = F.when(s % 3 == 0, F.concat(F.lit("SNE_"), (s % 50).cast("string"), F.lit("_201805"), two(33), F.lit("_05"), two(60), F.lit("02"))).when(
        s % 3 == 1, F.hex(s + 1500000000)).otherwise(F.concat(F.lit("site"), s.cast("string")))
    return tb.events(spark, d).select(stem.alias("stem")).distinct().withColumn("start_time", clock.parse_timestamp(F.col("stem")))


@query("F14_recording_ids", r"""SELECT DISTINCT url AS path, replace(regexp_replace(url, '\.[^./]*$', ''), '/', '__') AS recording_id, regexp_replace(regexp_extract(trim(url || '.WAV'), '([^\\/]*)$', 1), '\.(wav|flac|mp3|ogg|aiff?|m4a)$', '', 'i') AS stem FROM pages""")
def f14(spark, d):
    p = tb.table(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    return p.withColumn("recording_id", clock.recording_id_for(F.col("path"))).withColumn("stem", clock.file_stem(F.concat("path", F.lit(".WAV"))))


_TS = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


@query("F15_birdnet_week", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, ((month(o_orderdate) - 1) * 4 + least(4, (day(o_orderdate) - 1) // 7 + 1))::BIGINT AS week FROM orders")
def f15(spark, d):
    o = tb.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return o.withColumn("week", clock.birdnet_week(F.concat("day", F.lit("T05:00:00Z"))).cast("long"))


@query("F16_F17_strata", """SELECT recording_id, start_s, site || ' · ' || CASE WHEN h >= 21 OR h < 4 THEN 'night' WHEN h < 8 THEN 'dawn' WHEN h < 17 THEN 'day' ELSE 'dusk' END AS stratum FROM (
 SELECT recording_id, start_s, site, (start_s / 3600) % 24 AS h FROM e_win JOIN e_rec USING (recording_id) WHERE run_id = 'runA')""")
def f17(spark, d):
    w = tb.score_windows(spark, d).where("run_id = 'runA'").join(tb.recordings(spark, d), "recording_id")
    return w.select("recording_id", "start_s", clock.stratum(F.col("site"), F.col("start_time"), F.col("start_s")).alias("stratum"))


@query("F18_tiers", "SELECT recording_id, box_id, coalesce(tier, 3)::BIGINT AS tier FROM e_ann JOIN spp USING (species_key)")
def f18(spark, d):
    prof = tb.species(spark, d).where("tier is not null")
    return names.tiers(tb.annotations(spark, d), prof).select("recording_id", "box_id", *big("tier"))


@query("F18_plausible_keys", "SELECT species_key FROM spp WHERE tier <= 2")
def f18b(spark, d):
    return names.plausible_keys(tb.species(spark, d))


@query("F19_suggest_profile", """SELECT recording_id, (SELECT arg_min(p, (area, p)) FROM (SELECT 'n' || n_nationkey AS p, n_nationkey - 5 AS a, n_nationkey * 2 AS b, (n_nationkey + 5) * (n_nationkey * 2 + 200) AS area FROM nation) x
 WHERE lat BETWEEN a AND b AND lon BETWEEN -n - 200 AND n) AS profile FROM (SELECT recording_id, lat, lon, 0 AS n FROM e_rec)""".replace("-n - 200 AND n", "-200 AND 0").replace("(n_nationkey + 5) * (n_nationkey * 2 + 200)", "(n_nationkey + 5) * 200"))
def f19(spark, d):
    n = F.col("n_nationkey")
    boxes = tb.table(spark, d, "nation").select(
        F.concat(F.lit("n"), n.cast("string")).alias("profile"), (n - 5).cast("double").alias("min_lat"), (n * 2).cast("double").alias("max_lat"),
        F.lit(-200.0).alias("min_lon"), F.lit(0.0).alias("max_lon")).where("max_lat >= min_lat")
    return names.suggest_profile(tb.recordings(spark, d).select("recording_id", "lat", "lon"), boxes).select("recording_id", "profile")


@query("F20_unknown_species", "SELECT species_key FROM spp WHERE tier IS NOT NULL AND species_key NOT IN (SELECT species_key FROM e_ev WHERE event_id % 2 = 0)")
def f20(spark, d):
    return names.unknown_species(tb.species(spark, d).where("tier is not null"), tb.events(spark, d).where("event_id % 2 = 0"))


@query("F21_apply_occurrence", "SELECT run_id, recording_id, start_s, species_key, round(CASE WHEN idx <> 1 THEN occ END, 6) AS occ_score, idx <> 1 AND occ < 0.25 AS suppressed FROM e_det")
def f21(spark, d):
    occ = tb.species(spark, d).where("idx <> 1").select("species_key", F.col("occ").cast("float").alias("occ"))
    return ix.apply_occurrence(tb.detections(spark, d), occ, ["species_key"], 0.25).select(*ix.WIN, "species_key", *r6("occ_score"), "suppressed")


@query("F22_F23_F24_scalars", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(least(greatest(l_discount * 20 - 0.5, 0), 1), 6) AS clipped, round(CASE WHEN l_tax + l_discount > 0 THEN
 5 * l_tax * l_discount / (4 * l_tax + l_discount) ELSE 0 END, 6) AS f2, round(ln(least(greatest(l_tax * 10, 1e-9), 1 - 1e-9) / (1 - least(greatest(l_tax * 10, 1e-9), 1 - 1e-9))), 6) AS logit FROM lineitem""")
def f24(spark, d):
    from chorale.operators.calibrate import logit
    li = tb.table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                     F.round(clock.clip01(F.col("l_discount") * 20 - 0.5), 6).alias("clipped"), F.round(fbeta(F.col("l_tax"), F.col("l_discount"), 2.0), 6).alias("f2"),
                     F.round(logit(F.col("l_tax") * 10), 6).alias("logit"))


@query("F25_F26_F27_planning", """SELECT p_partkey, ceil(1.96 * 1.96 * 0.8 * 0.2 / ((p_size / 100.0) * (p_size / 100.0)))::BIGINT AS units, greatest(10, ceil(10 * (p_size / 20.0) * (p_size / 20.0) * 0.85))::BIGINT AS lo,
 greatest(10, ceil(10 * (p_size / 20.0) * (p_size / 20.0) * 1.3))::BIGINT AS hi, round(p_size * 5.6 * 8 / 3600, 6) AS hours_lo, round(p_size * 8.4 * 8 / 3600, 6) AS hours_hi FROM part""")
def f26(spark, d):
    s = F.col("p_size")
    p = tb.table(spark, d, "part")
    lo, hi = clock.project(s / 100.0, F.lit(10), F.lit(0.2))
    a, b = clock.volunteer_hours(s)
    return p.select("p_partkey", clock.units_for_margin(s / 100.0).cast("long").alias("units"), lo.alias("lo"), hi.alias("hi"), F.round(a, 6).alias("hours_lo"), F.round(b, 6).alias("hours_hi"))


@query("F28_saturated", "SELECT run_id, avg(CASE WHEN score >= 0.9999 THEN 1.0 ELSE 0 END) > 0.2 AS saturated, round(avg(CASE WHEN score >= 0.9999 THEN 1.0 ELSE 0 END), 6) AS share FROM e_det GROUP BY 1")
def f28(spark, d):
    from chorale.operators.calibrate import saturated
    return saturated(tb.detections(spark, d).withColumn("score", F.col("score_raw").cast("double")), ["run_id"]).select("run_id", "saturated", *r6("share"))


@query("F29_typical_for", """SELECT run_id, CASE WHEN model_name = 'm0' AND tok = 'softmax' THEN 0.977 WHEN model_name = 'm1' THEN 1.137 END::DOUBLE AS a, CASE WHEN model_name = 'm0' AND tok = 'softmax' THEN 2.459 WHEN model_name = 'm1' THEN -0.527 END::DOUBLE AS b FROM man""")
def f29(spark, d):
    from chorale.operators.calibrate import typical_for
    named = manifests(spark, d).withColumn("model_name", F.when(F.col("model_name") == "m0", "perch").when(F.col("model_name") == "m1", "birdnet").otherwise(F.col("model_name")))
    return typical_for(named).select("run_id", "a", "b")
