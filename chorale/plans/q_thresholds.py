"""Queries of thresholds and filter forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.operators import curves as cv
from chorale.operators import forensics as fx
from chorale.operators import thresholds as th
from chorale.params import Muddiness, RuleSpec
from chorale.plans import testbed as tb
from chorale.plans.q_metrics import rule_sql
from chorale.plans.registry import big, cte, query, r6
from chorale.params import Rule

SPEC = RuleSpec(min_labelled=200)
P95 = Rule("precision", 0.95)
BUCKET = 21600.0


# ------------------------------------------------------------------ thresholds
def _overrides(spark, d):
    return tb.species(spark, d).where("idx = 4").select(F.lit("runA").alias("model"), "species_key", F.lit(0.42).alias("theta"))


def _ties(spark, d):
    return cv.tie_counts(tb.aligned(spark, d).withColumnRenamed("run_id", "model"), ["model", "species_key"])


def _resolved(spark, d):
    ties = _ties(spark, d)
    curves = cv.curve_from_ties(ties, ["model", "species_key"])
    micro = cv.curve_from_ties(ties.groupBy("model", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["model"])
    return th.resolve(SPEC, curves, micro, overrides=_overrides(spark, d))


cte("t_fb", f"SELECT run_id AS model, theta AS fb FROM ({rule_sql('e_micro', 'run_id', P95)})")
cte("t_own", f"""SELECT k.run_id AS model, k.species_key, k.n_pos, x.theta AS own FROM (SELECT run_id, species_key, max(n_pos) AS n_pos
 FROM e_curve GROUP BY 1, 2) k LEFT JOIN ({rule_sql('e_curve', 'run_id, species_key', P95)}) x USING (run_id, species_key)""")
cte("t_res", """SELECT o.model, o.species_key,
 CASE WHEN o.model = 'runA' AND s.idx = 4 THEN 0.42 WHEN n_pos >= 200 AND own IS NOT NULL THEN own ELSE fb END AS theta,
 CASE WHEN o.model = 'runA' AND s.idx = 4 THEN 'override' WHEN n_pos >= 200 AND own IS NOT NULL THEN 'rule'
   WHEN fb IS NOT NULL THEN 'fallback' ELSE 'none' END AS source
 FROM t_own o JOIN spp s USING (species_key) LEFT JOIN t_fb f ON f.model = o.model
 UNION ALL SELECT m.model, NULL, fb, CASE WHEN fb IS NULL THEN 'none' ELSE 'fallback' END FROM (SELECT DISTINCT model FROM t_own) m
 LEFT JOIN t_fb USING (model)""")


@query("T1_resolve", "SELECT model, coalesce(species_key, '*') AS species_key, round(theta, 6) AS theta, source FROM t_res")
def t1(spark, d):
    return _resolved(spark, d).select("model", F.coalesce("species_key", F.lit("*")).alias("species_key"), *r6("theta"), "source")


@query("T1_resolve_fixed", """SELECT CASE WHEN species_key IS NULL THEN '*' ELSE species_key END AS species_key, model,
 CASE WHEN model = 'runA' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS theta, CASE WHEN species_key IS NULL THEN 'fallback' ELSE 'rule' END AS source,
 'theta given for the model' AS reason FROM (SELECT model, species_key FROM t_own UNION ALL SELECT DISTINCT model, NULL FROM t_own)""")
def t1f(spark, d):
    spec = RuleSpec(kind="fixed", fixed={"runA": 0.3})
    return th.resolve(spec, cv.curve_from_ties(_ties(spark, d), ["model", "species_key"])).select(
        F.coalesce("species_key", F.lit("*")).alias("species_key"), "model", *r6("theta"), "source", "reason")


ATTACH = """SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score_raw, round(coalesce(r.theta, f.theta), 6) AS theta,
 coalesce(score >= coalesce(r.theta, f.theta), false) AS above FROM e_det d LEFT JOIN t_res r ON r.model = d.run_id AND r.species_key = d.species_key
 LEFT JOIN t_res f ON f.model = d.run_id AND f.species_key IS NULL"""


@query("T2_attach", ATTACH.replace("species_key, round(score", "d.species_key, round(score").replace("round(coalesce(r.theta", "round(coalesce(r.theta"))
def t2(spark, d):
    res = _resolved(spark, d).withColumnRenamed("model", "run_id")
    det = th.attach(tb.detections(spark, d), res, res.where("species_key is null"), ("run_id",))
    return det.select("run_id", "recording_id", "start_s", "species_key", *r6("score_raw", "theta"), "above")


cte("e_margin", """SELECT *, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6)))
 - ln(least(greatest(theta, 1e-6), 1 - 1e-6) / (1 - least(greatest(theta, 1e-6), 1 - 1e-6))), 9) AS m FROM e_det WHERE above""")
cte("e_strength", """SELECT *, 0.15 + 0.85 * (rank() OVER (PARTITION BY run_id ORDER BY m) - 1
 + (count(*) OVER (PARTITION BY run_id, m) - 1) / 2) / greatest(count(*) OVER (PARTITION BY run_id) - 1, 1) AS strength FROM e_margin""")


@query("T3_strength", """SELECT run_id, recording_id, start_s, species_key, round(strength, 5) AS strength FROM e_det
 LEFT JOIN (SELECT run_id, recording_id, start_s, species_key, strength FROM e_strength) USING (run_id, recording_id, start_s, species_key)""")
def t3(spark, d):
    return th.strength(tb.thresholded(spark, d), ["run_id"]).select(
        "run_id", "recording_id", "start_s", "species_key", F.round("strength", 5).alias("strength"))


@query("T4_build_set", """SELECT 'night' AS set_name, CASE WHEN species_key IS NULL THEN 'default' ELSE 'snapshot' END AS part, model,
 coalesce(species_key, '*') AS species_key, round(theta, 6) AS theta FROM t_res
 UNION ALL SELECT 'night', 'override', 'runA', species_key, 0.42 FROM spp WHERE idx = 4""")
def t4(spark, d):
    return th.build_set("night", _resolved(spark, d), _overrides(spark, d)).select(
        "set_name", "part", "model", F.coalesce("species_key", F.lit("*")).alias("species_key"), *r6("theta"))


@query("T5_stale", """SELECT 'runB' AS model, count(*) FILTER (species_key IS NOT NULL) AS entries FROM t_res WHERE model = 'runB'""")
def t5(spark, d):
    rows = th.build_set("night", _resolved(spark, d), _overrides(spark, d))
    present = tb.scored(spark, d).where("run_id = 'runA'").select(F.col("run_id").alias("model"))
    return th.stale(rows, present).select("model", *big("entries"))


@query("F30_set_json", """SELECT 'night' AS set_name, CASE WHEN species_key IS NULL THEN 'default' ELSE 'snapshot' END AS part, model,
 coalesce(species_key, '*') AS species_key, round(theta, 6) AS theta FROM t_res
 UNION ALL SELECT 'night', 'override', 'runA', species_key, 0.42 FROM spp WHERE idx = 4""")
def f30(spark, d):
    docs = th.set_to_json(th.build_set("night", _resolved(spark, d), _overrides(spark, d)), SPEC)
    return th.set_from_json(docs).select("set_name", "part", "model", F.coalesce("species_key", F.lit("*")).alias("species_key"), *r6("theta"))


@query("T6_borrowed_fit", """SELECT model, species_key, round(theta, 6) AS theta FROM t_res WHERE model = 'runA' AND species_key IS NOT NULL""")
def t6(spark, d):
    """Dataset = site: the thetas come from the smallest other labelled site's run of the same identity."""
    sets = _resolved(spark, d).where("species_key is not null").withColumn("run_id", F.col("model"))
    sites = tb.recordings(spark, d).select(F.col("site").alias("dataset"), "labelled").distinct()
    runs = sites.withColumn("run_id", F.explode(F.array(F.lit("runA"), F.lit("runB")))).withColumn("identity", F.col("run_id"))
    per_site = sets.withColumn("dataset", F.explode(F.array(*[F.lit(f"site{i}") for i in range(5)])))
    return th.borrowed(per_site, runs, "runA", "site1").select("model", "species_key", *r6("theta"))


@query("T7_theta_of", "SELECT species_key, round(theta, 6) AS theta FROM t_res WHERE model = 'runB' AND species_key IS NOT NULL")
def t7(spark, d):
    return _resolved(spark, d).where("model = 'runB' and species_key is not null").select("species_key", *r6("theta"))


# ------------------------------------------------------------------ forensics at one theta
CFG = Muddiness(theta=0.5)
cte("hits", "SELECT * FROM e_det WHERE score >= 0.5")


def _hits(spark, d):
    return fx.at_theta(tb.detections(spark, d), CFG.theta)


@query("P1_mark_implausible", """SELECT run_id, recording_id, start_s, species_key, suppressed AS geofilter, coalesce(tier, 3) >= 3 AS profile,
 suppressed OR coalesce(tier, 3) >= 3 AS either FROM e_det""")
def p1(spark, d):
    det, prof = tb.detections(spark, d), tb.species(spark, d)
    g = fx.mark_implausible(det).withColumnRenamed("implausible", "geofilter")
    p = fx.mark_implausible(g, prof, "profile").withColumnRenamed("implausible", "profile")
    return fx.mark_implausible(p, prof, "either").select(
        "run_id", "recording_id", "start_s", "species_key", "geofilter", "profile", F.col("implausible").alias("either"))


@query("P2_suppression_events", "SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score_raw FROM hits WHERE implausible")
def p2(spark, d):
    return fx.suppression_events(_hits(spark, d)).select("run_id", "recording_id", "start_s", "species_key", *r6("score_raw"))


@query("P3_detection_windows", "SELECT DISTINCT run_id, recording_id, start_s FROM hits")
def p3(spark, d):
    return fx.detection_windows(_hits(spark, d), ["run_id"])


cte("p_mass", """SELECT run_id, recording_id, start_s, bool_or(implausible) AS muddy, sum(score) AS total,
 coalesce(sum(score) FILTER (implausible), 0) / sum(score) AS mass FROM hits GROUP BY 1, 2, 3""")


@query("P4_muddy_window_rate", """SELECT run_id, count(*) AS windows, count(*) FILTER (muddy) AS muddy_windows,
 round(count(*) FILTER (muddy) / count(*), 6) AS muddy_window_rate FROM p_mass GROUP BY 1""")
def p4(spark, d):
    return fx.muddy_window_rate(_hits(spark, d), ["run_id"]).select("run_id", *big("windows", "muddy_windows"), *r6("muddy_window_rate"))


@query("P5_window_impostor_mass", "SELECT run_id, recording_id, start_s, round(mass, 5) AS impostor_mass FROM p_mass")
def p5(spark, d):
    return fx.window_masses(_hits(spark, d), ["run_id"]).select("run_id", "recording_id", "start_s", F.round("impostor_mass", 5).alias("impostor_mass"))


cte("p_mud", """SELECT a.run_id, a.species_key, count(*) AS windows, avg(a.score) AS mean_score, avg(a.c) AS companions, avg(a.ic) AS implausible_companions,
 avg(m.mass) AS impostor_mass FROM (SELECT a.*, (SELECT count(*) FROM hits b WHERE b.run_id = a.run_id AND b.recording_id = a.recording_id
 AND b.start_s = a.start_s AND b.species_key <> a.species_key AND b.score >= a.score - 0.15::DOUBLE) AS c,
 (SELECT count(*) FROM hits b WHERE b.run_id = a.run_id AND b.recording_id = a.recording_id
 AND b.start_s = a.start_s AND b.species_key <> a.species_key AND b.implausible AND b.score >= a.score - 0.15::DOUBLE) AS ic FROM hits a) a
 JOIN p_mass m USING (run_id, recording_id, start_s) GROUP BY 1, 2""")


@query("P6_muddiness", """SELECT run_id, species_key, windows, round(mean_score, 5) AS mean_score, round(companions, 6) AS companions,
 round(implausible_companions, 6) AS implausible_companions, round(impostor_mass, 5) AS impostor_mass FROM p_mud""")
def p6(spark, d):
    return fx.per_species_muddiness(_hits(spark, d), ["run_id"], CFG).select(
        "run_id", "species_key", *big("windows"), F.round("mean_score", 5).alias("mean_score"), *r6("companions", "implausible_companions"),
        F.round("impostor_mass", 5).alias("impostor_mass"))


@query("P7_muddiness_spread", """SELECT run_id, count(*) AS species, round(quantile_cont(companions, 0.5), 6) AS median, round(quantile_cont(companions, 0.25), 6) AS p25,
 round(quantile_cont(companions, 0.75), 6) AS p75, round(quantile_cont(companions, 0.75) - quantile_cont(companions, 0.25), 6) AS iqr
 FROM p_mud WHERE windows >= 5 GROUP BY 1""")
def p7(spark, d):
    return fx.muddiness_spread(fx.per_species_muddiness(_hits(spark, d), ["run_id"], CFG), ["run_id"]).select(
        "run_id", *big("species"), *r6("median", "p25", "p75", "iqr"))


cte("p_shadow", """SELECT a.run_id, a.recording_id, a.start_s, a.species_key, a.score, b.species_key AS rival_key, b.score AS rival_score, b.occ AS rival_occ,
 a.score - b.score AS gap, split_part(a.species_key, ' ', 1) = split_part(b.species_key, ' ', 1) AS congeneric
 FROM hits a JOIN hits b USING (run_id, recording_id, start_s) WHERE NOT a.implausible AND b.implausible AND b.score >= a.score - 0.15::DOUBLE""")


@query("P8_shadowed_detections", """SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score_raw, rival_key, round(rival_score, 6) AS rival_score,
 round(rival_occ, 6) AS rival_occ, round(gap, 6) AS gap, congeneric FROM p_shadow""")
def p8(spark, d):
    return fx.shadowed_detections(_hits(spark, d), ["run_id"], CFG.delta).select(
        "run_id", "recording_id", "start_s", "species_key", "rival_key", *r6("score_raw", "rival_score", "rival_occ", "gap"), "congeneric")


@query("P9_shadowed_pairs", """SELECT run_id, species_key, rival_key, count(*) AS windows, round(avg(gap), 5) AS mean_gap, bool_or(congeneric) AS congeneric
 FROM p_shadow GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, species_key, rival_key) <= 10""")
def p9(spark, d):
    return fx.shadowed_pairs(fx.shadowed_detections(_hits(spark, d), ["run_id"], CFG.delta), ["run_id"], 10).select(
        "run_id", "species_key", "rival_key", *big("windows"), F.round("mean_gap", 5).alias("mean_gap"), "congeneric")


def _fe_sql(src: str, arm: str, det: str = "e_det") -> str:
    return f"""SELECT {arm}, NOT bool_or(ever_imp AND present) AS degenerate_false_suppression, NOT bool_or(ever_ok AND NOT present) AS degenerate_false_admission,
 sum(tp)::BIGINT AS true_positive_detections, sum(fs)::BIGINT AS false_suppressions, round(sum(fs) / nullif(sum(tp), 0), 6) AS false_suppression_rate,
 coalesce(string_agg(species_key, '|' ORDER BY species_key) FILTER (fs > 0), '') AS false_suppressed_species, sum(adm)::BIGINT AS admitted_detections,
 coalesce(sum(adm) FILTER (NOT present), 0)::BIGINT AS false_admissions, round(coalesce(sum(adm) FILTER (NOT present), 0) / nullif(sum(adm), 0), 6) AS false_admission_rate
 FROM (SELECT {arm}, species_key, bool_or(implausible) AS ever_imp, bool_or(NOT implausible) AS ever_ok,
  species_key IN (SELECT species_key FROM e_ann) AS present, count(*) FILTER (h AND agrees) AS tp, count(*) FILTER (h AND agrees AND implausible) AS fs,
  count(*) FILTER (h AND NOT implausible) AS adm FROM (SELECT x.*, EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = x.recording_id
  AND a.species_key = x.species_key AND a.end_s > x.start_s AND a.start_s < x.end_s) AS agrees FROM ({src}) x) GROUP BY {arm}, species_key) GROUP BY {arm}"""


@query("P10_filter_errors", _fe_sql("SELECT *, score >= 0.5 AS h FROM e_det", "run_id"))
def p10(spark, d):
    return fx.filter_errors(_hits(spark, d), tb.annotations(spark, d), ["run_id"], BUCKET).select(
        "run_id", "degenerate_false_suppression", "degenerate_false_admission", "false_suppressed_species",
        *big("true_positive_detections", "false_suppressions", "admitted_detections", "false_admissions"),
        *r6("false_suppression_rate", "false_admission_rate"))


@query("P11_excluded_present_species", """SELECT run_id, species_key, round(max(occ), 6) AS max_occ, round(max(score), 6) AS max_score FROM e_det
 WHERE species_key IN (SELECT species_key FROM e_ann) GROUP BY 1, 2 HAVING max(occ) < 0.25""")
def p11(spark, d):
    return fx.excluded_present_species(tb.detections(spark, d), tb.annotations(spark, d), ["run_id"], 0.25).select(
        "run_id", "species_key", *r6("max_occ", "max_score"))


@query("P12_theta_for_detection_count", """SELECT run_id, round(score, 6) AS theta FROM (SELECT run_id, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC) AS i,
 count(*) OVER (PARTITION BY run_id) AS n FROM e_det) WHERE i = least(1500, n)""")
def p12(spark, d):
    return fx.theta_for_count(tb.detections(spark, d), ["run_id"], 1500).select("run_id", *r6("theta"))


def _league_sql(budgets: str, arm: str) -> str:
    """League rows at matched counts: `budgets` gives (run_id, budget)."""
    return f"""WITH th AS (SELECT run_id, budget, score AS theta_m FROM (SELECT d.run_id, b.budget, score, row_number() OVER (PARTITION BY d.run_id, b.budget ORDER BY score DESC) AS i,
 count(*) OVER (PARTITION BY d.run_id, b.budget) AS n FROM e_det d JOIN ({budgets}) b USING (run_id)) WHERE i = least(budget, n)),
 bd AS (SELECT d.*, budget, theta_m, score >= theta_m AS h FROM e_det d JOIN th USING (run_id)),
 bh AS (SELECT * FROM bd WHERE h),
 ms AS (SELECT run_id, budget, recording_id, start_s, bool_or(implausible) AS muddy, coalesce(sum(score) FILTER (implausible), 0) / sum(score) AS mass FROM bh GROUP BY 1, 2, 3, 4),
 sh AS (SELECT a.run_id, a.budget, count(*) AS shadowed, count(*) FILTER (split_part(a.species_key, ' ', 1) = split_part(b.species_key, ' ', 1)) AS cong
  FROM bh a JOIN bh b USING (run_id, budget, recording_id, start_s) WHERE NOT a.implausible AND b.implausible AND b.score >= a.score - 0.15::DOUBLE GROUP BY 1, 2),
 mu AS (SELECT run_id, budget, median(c) AS med, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr FROM (SELECT run_id, budget, species_key, count(*) AS w, avg(c) AS c FROM (
  SELECT a.run_id, a.budget, a.species_key, (SELECT count(*) FROM bh b WHERE b.run_id = a.run_id AND b.budget = a.budget AND b.recording_id = a.recording_id AND b.start_s = a.start_s
  AND b.species_key <> a.species_key AND b.score >= a.score - 0.15::DOUBLE) AS c FROM bh a) GROUP BY 1, 2, 3) WHERE w >= 5 GROUP BY 1, 2),
 fe AS ({_fe_sql('SELECT * FROM bd', 'run_id, budget')})
 SELECT c.run_id, c.budget::BIGINT AS budget, round(c.theta_m, 6) AS theta, c.detections, c.suppression_events, w.detection_windows, round(w.rate, 6) AS muddy_window_rate, round(w.med, 5) AS median_impostor_mass,
 coalesce(shadowed, 0) AS shadowed_detections, coalesce(cong, 0) AS congeneric_shadowed, round(mu.med, 6) AS species_muddiness_median, round(mu.iqr, 6) AS species_muddiness_iqr,
 fe.false_suppressions, fe.false_suppression_rate, fe.false_admissions, fe.false_admission_rate
 FROM (SELECT run_id, budget, any_value(theta_m) AS theta_m, count(*) FILTER (h) AS detections, count(*) FILTER (h AND implausible) AS suppression_events FROM bd GROUP BY 1, 2) c
 JOIN (SELECT run_id, budget, count(*) AS detection_windows, count(*) FILTER (muddy) / count(*) AS rate, median(mass) AS med FROM ms GROUP BY 1, 2) w USING (run_id, budget)
 LEFT JOIN sh USING (run_id, budget) LEFT JOIN mu USING (run_id, budget) LEFT JOIN fe USING (run_id, budget)"""


def wrap(sql: str) -> str:
    """A statement with its own WITH as a subquery, so shared building blocks can precede it."""
    return f"SELECT * FROM ({sql})"


def _league_out(df):
    return df.select("run_id", *big("budget", "detections", "suppression_events", "detection_windows", "shadowed_detections", "congeneric_shadowed",
                                    "false_suppressions", "false_admissions"),
                     *r6("theta", "muddy_window_rate", "species_muddiness_median", "species_muddiness_iqr", "false_suppression_rate", "false_admission_rate"),
                     F.round("median_impostor_mass", 5).alias("median_impostor_mass"))


def league_budgets(spark, d, budgets):
    det = fx.with_budgets(tb.detections(spark, d), ["run_id"], budgets)
    arm = ["run_id", "budget"]
    th_ = det.groupBy(*arm).agg(F.max("theta").alias("theta"))
    return fx.league(det, arm, CFG, tb.annotations(spark, d), BUCKET).join(th_, arm)


@query("P13_matched_league", wrap(_league_sql("SELECT run_id, 1200 AS budget FROM runs", "run_id")))
def p13(spark, d):
    return _league_out(league_budgets(spark, d, [1200]))


@query("P13_default_target", """SELECT greatest(min(n), 1)::BIGINT AS target FROM (SELECT run_id, count(*) FILTER (score >= 0.1) AS n FROM e_det GROUP BY 1)""")
def p13t(spark, d):
    return fx.smallest_arm(tb.detections(spark, d), ["run_id"]).select(*big("target"))


@query("P14_league_row", """SELECT c.run_id, c.detections, c.suppression_events, w.detection_windows, round(w.rate, 6) AS muddy_window_rate, round(w.med, 5) AS median_impostor_mass,
 coalesce(s.n, 0) AS shadowed_detections, coalesce(s.cong, 0) AS congeneric_shadowed, round(m.med, 6) AS species_muddiness_median
 FROM (SELECT run_id, count(*) AS detections, count(*) FILTER (implausible) AS suppression_events FROM hits GROUP BY 1) c
 JOIN (SELECT run_id, count(*) AS detection_windows, count(*) FILTER (muddy) / count(*) AS rate, median(mass) AS med FROM p_mass GROUP BY 1) w USING (run_id)
 LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (congeneric) AS cong FROM p_shadow GROUP BY 1) s USING (run_id)
 LEFT JOIN (SELECT run_id, median(companions) AS med FROM p_mud WHERE windows >= 5 GROUP BY 1) m USING (run_id)""")
def p14(spark, d):
    return fx.league(_hits(spark, d), ["run_id"], CFG).select(
        "run_id", *big("detections", "suppression_events", "detection_windows", "shadowed_detections", "congeneric_shadowed"),
        *r6("muddy_window_rate", "species_muddiness_median"), F.round("median_impostor_mass", 5).alias("median_impostor_mass"))


@query("P15_operating_points", wrap(_league_sql("SELECT run_id, unnest([300, 800, 1500, 2500]) AS budget FROM runs", "run_id")))
def p15(spark, d):
    return _league_out(league_budgets(spark, d, [300, 800, 1500, 2500]))


# species by place and three days, so that arms differ in some
cte("p_local", "SELECT * REPLACE (species_key || ' ' || recording_id || '.' || CAST(floor(start_s / 259200) AS BIGINT) AS species_key) FROM e_det")


@query("P16_species_agreement", """SELECT species_key, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only a' ELSE 'only b' END AS side,
 species_key IN (SELECT species_key || ' ' || recording_id || '.' || CAST(floor(start_s / 259200) AS BIGINT) FROM e_ann) AS annotated FROM (SELECT species_key, bool_or(run_id = 'runA') AS a, bool_or(run_id = 'runB') AS b
 FROM p_local WHERE above GROUP BY 1)""")
def p16(spark, d):
    """Every detection at the project's thetas, suppressed or not."""
    placed = lambda df: df.withColumn("species_key", F.concat_ws(" ", "species_key", F.concat_ws(".", "recording_id", F.floor(F.col("start_s") / 259200).cast("string"))))
    return fx.agreement(fx.reported_species(placed(tb.thresholded(spark, d).withColumn("hit", F.col("above"))), ["run_id"]), "run_id", "runA", "runB", placed(tb.annotations(spark, d)))


@query("P17_most_suppressed", """SELECT run_id, species_key, count(*) AS events, round(max(score), 6) AS peak FROM hits WHERE implausible GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, species_key) <= 2""")
def p17(spark, d):
    t = fx.suppression_events(_hits(spark, d)).groupBy("run_id", "species_key").agg(F.count(F.lit(1)).alias("events"), F.max("score_raw").alias("peak"))
    return fx.top_bottom(t, ["run_id"], "events", 2).where("end = 'top'").select("run_id", "species_key", *big("events"), *r6("peak"))


@query("P17_mass_p90", "SELECT run_id, round(quantile_cont(mass, 0.9), 5) AS p90 FROM p_mass GROUP BY 1")
def p17b(spark, d):
    from chorale.operators.prefix import exact_quantiles
    return exact_quantiles(fx.window_masses(_hits(spark, d), ["run_id"]), ["run_id"], "impostor_mass", {"p90": 0.9}).select(
        "run_id", F.round("p90", 5).alias("p90"))


@query("P18_muddiest_cleanest", """SELECT run_id, species_key, 'top' AS side, round(companions, 6) AS companions FROM p_mud
 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY companions DESC, species_key) <= 3 UNION ALL
 SELECT run_id, species_key, 'bottom', round(companions, 6) FROM p_mud QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY companions, species_key) <= 3""")
def p18(spark, d):
    t = fx.per_species_muddiness(_hits(spark, d), ["run_id"], CFG)
    return fx.top_bottom(t, ["run_id"], "companions", 3).select("run_id", "species_key", F.col("end").alias("side"), *r6("companions"))


# ------------------------------------------------------------------ at per-species thresholds
cte("judged", """SELECT d.*, EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = d.recording_id AND a.species_key = d.species_key
 AND least(a.end_s, d.end_s) - greatest(a.start_s, d.start_s) >= 0.5) AS is_real FROM e_det d WHERE above""")


def _judged(spark, d):
    return fx.with_truth(tb.thresholded(spark, d), tb.annotations(spark, d), ["run_id"], BUCKET)


@query("Q1_reported", "SELECT run_id, recording_id, start_s, species_key FROM e_det WHERE above")
def q1(spark, d):
    return fx.with_truth(tb.thresholded(spark, d), None, ["run_id"], BUCKET).select("run_id", "recording_id", "start_s", "species_key")


@query("Q2_with_truth", "SELECT run_id, recording_id, start_s, species_key, is_real AS real FROM judged")
def q2(spark, d):
    return _judged(spark, d).select("run_id", "recording_id", "start_s", "species_key", "real")


@query("Q3_Q4_outcomes", """SELECT run_id, c AS correct, w AS wrong, m AS caught_mistake, h AS hid_real, round((c + h) / (c + h + w + m), 6) AS precision_before,
 round(c / (c + w), 6) AS precision_after FROM (SELECT run_id, count(*) FILTER (is_real AND NOT implausible) AS c, count(*) FILTER (NOT is_real AND NOT implausible) AS w,
 count(*) FILTER (NOT is_real AND implausible) AS m, count(*) FILTER (is_real AND implausible) AS h FROM judged GROUP BY 1)""")
def q3(spark, d):
    return fx.filter_outcomes(_judged(spark, d), ["run_id"]).select(
        "run_id", *big("correct", "wrong", "caught_mistake", "hid_real"), *r6("precision_before", "precision_after"))


@query("Q3_outcomes_without_truth", """SELECT run_id, count(*) FILTER (NOT implausible) AS let_through, count(*) FILTER (implausible) AS hidden FROM judged GROUP BY 1""")
def q3b(spark, d):
    return fx.filter_outcomes(fx.with_truth(tb.thresholded(spark, d), None, ["run_id"], BUCKET), ["run_id"]).select("run_id", *big("let_through", "hidden"))


@query("Q6_muddy_windows", """SELECT run_id, count(*) AS windows, count(*) FILTER (m) AS muddy_windows, round(count(*) FILTER (m) / count(*), 6) AS muddy_window_rate
 FROM (SELECT run_id, recording_id, start_s, bool_or(implausible) AS m FROM e_det WHERE above GROUP BY 1, 2, 3) GROUP BY 1""")
def q6(spark, d):
    return fx.muddy_window_rate(tb.thresholded(spark, d).withColumn("hit", F.col("above")), ["run_id"]).select(
        "run_id", *big("windows", "muddy_windows"), *r6("muddy_window_rate"))


@query("Q7_impossible_species", """SELECT run_id, species_key, count(*) AS detections, count(DISTINCT recording_id) AS recordings, round(max(score), 6) AS peak,
 count(*) FILTER (is_real) AS real FROM judged WHERE implausible GROUP BY 1, 2""")
def q7(spark, d):
    return fx.impossible_species(_judged(spark, d), ["run_id"]).select("run_id", "species_key", *big("detections", "recordings", "real"), *r6("peak"))


@query("Q8_unreportable", """SELECT run_id, species_key FROM e_det WHERE species_key IN (SELECT species_key FROM e_ann) GROUP BY 1, 2 HAVING bool_and(implausible)""")
def q8(spark, d):
    return fx.unreportable(tb.detections(spark, d), tb.annotations(spark, d), ["run_id"])


@query("Q9_circular", """SELECT run_id, NOT bool_or(implausible AND species_key IN (SELECT species_key FROM e_ann)) AS circular,
 count(DISTINCT species_key) FILTER (species_key IN (SELECT species_key FROM e_ann)) AS annotated_seen FROM e_det GROUP BY 1""")
def q9(spark, d):
    return fx.circular(tb.detections(spark, d), tb.annotations(spark, d), ["run_id"]).select("run_id", "circular", *big("annotated_seen"))
