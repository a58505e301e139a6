"""Queries of the survey protocol and frozen setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.operators import heldout as ho
from chorale.operators import survey as sv
from chorale.operators.curves import tie_counts
from chorale.operators.resample import POISSON_1
from chorale.params import FIRM_FLOORS, FLOORS, KS, Condition, Constraints, RuleSpec, SurveyRule
from chorale.plans import testbed as tb
from chorale.plans.registry import big, cte, query, r6
from chorale.session import spread

ARM = ["run_id"]
RULE = SurveyRule(Condition(0.5, 2), Condition(0.9, 2))
SPAN_RULE = SurveyRule(Condition(0.5, 1, 86400.0), Condition(0.9, 3, 86400.0))
SPEC = RuleSpec()
CONS = Constraints(min_firm_precision=0.6, max_checks_per_recording=4.0)
N_BOOT = 1000
MODELS = list(tb.RUNS)
#: Seconds of a visit: the survey's recordings are the visits to each place, boxes are cut at their ends.
VISIT = 259200
#: The name under which the survey's annotators file a species that they do not tell apart.
TOLD_AS = ("Setophaga petechia", "Poecile gambeli")


def _values(xs) -> str:
    return ", ".join(f"({x!r}::DOUBLE)" for x in xs)


def _bars_sql(curve: str, micro: str, keys: str) -> str:
    using = f"USING ({keys}, floor)"
    return f"""SELECT {keys}, floor, species_key, CASE WHEN n_pos >= 10 AND own IS NOT NULL THEN own ELSE fb END AS theta FROM (
 SELECT {keys}, floor, species_key, max(n_pos) AS n_pos FROM {curve}, floors GROUP BY ALL)
 LEFT JOIN (SELECT {keys}, floor, species_key, theta AS own FROM {curve}, floors WHERE precision >= floor AND tp + fp >= 10
  QUALIFY row_number() OVER (PARTITION BY {keys}, floor, species_key ORDER BY recall DESC, theta DESC) = 1) USING ({keys}, floor, species_key)
 LEFT JOIN (SELECT {keys}, floor, theta AS fb FROM {micro}, floors WHERE precision >= floor AND tp + fp >= 10
  QUALIFY row_number() OVER (PARTITION BY {keys}, floor ORDER BY recall DESC, theta DESC) = 1) {using}"""


cte("floors", f"SELECT * FROM (VALUES {_values(FLOORS)}) t(floor)")
cte("ffloors", f"SELECT * FROM (VALUES {_values(FIRM_FLOORS)}) t(floor)")
cte("ks", f"SELECT * FROM (VALUES {', '.join(f'({k})' for k in KS)}) t(k)")
cte("bars", _bars_sql("e_curve", "e_micro", "run_id"))
RE = "regexp_matches(d.species_key, '^[A-Z][a-z]+ [a-z\\-]+( [a-z\\-]+)?$')"
cte("v_rec", f"SELECT recording_id || '.' || b AS recording_id, recording_id AS place, labelled FROM e_rec, range(0, CAST(2592000 / {VISIT} AS INTEGER)) t(b)")
_AT = f"recording_id || '.' || CAST(floor(start_s / {VISIT}) AS INTEGER)"
cte("v_det", f"SELECT * REPLACE ({_AT} AS recording_id) FROM e_det")
cte("v_ann", f"""SELECT a.recording_id || '.' || b AS recording_id, CASE WHEN species_key = '{TOLD_AS[0]}' THEN '{TOLD_AS[1]}' ELSE species_key END AS species_key
 FROM e_ann a, range(0, CAST(2592000 / {VISIT} AS INTEGER)) t(b) WHERE start_s < (b + 1) * {VISIT} AND end_s > b * {VISIT}""")
cte("above_bar", f"SELECT d.run_id, d.recording_id, d.start_s, d.species_key, d.implausible, b.floor FROM v_det d JOIN bars b USING (run_id, species_key) WHERE d.score >= b.theta AND {RE}")
cte("evid", "SELECT run_id, recording_id, species_key, floor, count(*) AS n_all, count(*) FILTER (NOT implausible) AS n_shown FROM above_bar GROUP BY ALL")
cte("truth", "SELECT DISTINCT recording_id, species_key FROM v_ann")
cte("label_set", "SELECT DISTINCT species_key FROM v_ann")


def visits(df):
    """A frame of windows or detections with its recordings cut into visits; no window crosses a visit's end."""
    return df.withColumn("recording_id", F.concat_ws(".", "recording_id", F.floor(F.col("start_s") / VISIT).cast("string")))


def detections(spark, d):
    return tb.stored(spark, d, "visit_detections", lambda: sv.species_only(visits(tb.detections(spark, d)), ARM))


def annotations(spark, d):
    """The boxes, one row per visit that they touch, under the names that the annotators use."""
    b = F.explode(F.sequence(F.floor(F.col("start_s") / VISIT), F.ceil(F.col("end_s") / VISIT) - 1))
    told = F.when(F.col("species_key") == TOLD_AS[0], TOLD_AS[1]).otherwise(F.col("species_key"))
    return tb.annotations(spark, d).select("recording_id", told.alias("species_key"), "start_s", "end_s", b.alias("_b")).where(
        F.col("_b") < int(tb.DURATION_S) // VISIT).withColumn("recording_id", F.concat_ws(".", "recording_id", F.col("_b").cast("string"))).drop("_b")


def truth(spark, d):
    return tb.stored(spark, d, "visit_truth", lambda: sv.truth_pairs(annotations(spark, d)))


def truth_by_run(spark, d):
    return truth(spark, d).withColumn("run_id", F.explode(F.array(*[F.lit(m) for m in MODELS])))


def label_set(spark, d):
    return truth(spark, d).select("species_key").distinct()


def recordings(spark, d):
    return spread(tb.recordings(spark, d), "recording_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(int(tb.DURATION_S) // VISIT - 1)))).withColumn(
        "recording_id", F.concat_ws(".", "recording_id", F.col("_b").cast("string"))).withColumn("duration_s", F.lit(float(VISIT))).drop("_b")


def recs(spark, d):
    return recordings(spark, d).select("recording_id", (F.col("duration_s") / 3600).alias("hours"))


def recs_by_run(spark, d):
    return recs(spark, d).withColumn("run_id", F.explode(F.array(*[F.lit(m) for m in MODELS])))


def _ties(spark, d):
    return tie_counts(tb.aligned(spark, d), [*ARM, "species_key"])


def bars(spark, d):
    return tb.stored(spark, d, "bars", lambda: sv.fit_bars(_ties(spark, d), ARM, SPEC))


def ev(spark, d, spans=()):
    def build():
        det = detections(spark, d)  # counts of all bars wait in a task for each group it meets, so a task takes whole groups
        return sv.evidence(spread(det, *ARM, *sv.PAIR, rows=det.count()), bars(spark, d), ARM, spans)
    return tb.stored(spark, d, f"evidence{spans}", build)


@query("V2_fit_bars", "SELECT run_id, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, species_key, round(theta, 6) AS theta FROM bars")
def v2(spark, d):
    return bars(spark, d).where("species_key is not null").select(*ARM, "bar", "species_key", *r6("theta"))


@query("V3_species_only", f"SELECT run_id, recording_id, start_s, species_key, round(score, 6) AS score_raw, implausible FROM v_det d WHERE {RE}")
def v3(spark, d):
    return detections(spark, d).select(*ARM, "recording_id", "start_s", "species_key", *r6("score_raw"), "implausible")


@query("V4_evidence", "SELECT run_id, recording_id, species_key, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, n_all, n_shown FROM evid")
def v4(spark, d):
    return ev(spark, d).select(*ARM, "recording_id", "species_key", "bar", *big("n_all", "n_shown"))


cte("span_evid", """SELECT run_id, recording_id, species_key, floor, max(a) AS w_all, max(s) AS w_shown FROM (SELECT *,
 (SELECT count(*) FROM above_bar y WHERE y.run_id = x.run_id AND y.recording_id = x.recording_id AND y.species_key = x.species_key AND y.floor = x.floor
  AND y.start_s >= x.start_s AND y.start_s < x.start_s + 86400) AS a,
 CASE WHEN x.implausible THEN 0 ELSE (SELECT count(*) FROM above_bar y WHERE y.run_id = x.run_id AND y.recording_id = x.recording_id AND y.species_key = x.species_key AND y.floor = x.floor
  AND NOT y.implausible AND y.start_s >= x.start_s AND y.start_s < x.start_s + 86400) END AS s FROM above_bar x) GROUP BY 1, 2, 3, 4""")


@query("V5_span_max", "SELECT run_id, recording_id, species_key, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, w_all, w_shown FROM span_evid")
def v5(spark, d):
    return ev(spark, d, (86400.0,)).select(*ARM, "recording_id", "species_key", "bar", F.col("w86400_all").cast("long").alias("w_all"), F.col("w86400_shown").cast("long").alias("w_shown"))


def _tiers_sql(fk: int, ck: int, src: str = "evid", a: str = "n_all", s: str = "n_shown") -> str:
    return f"""SELECT *, CASE WHEN firm_shown >= {fk} THEN 'firm' WHEN check_shown >= {ck} THEN 'check' ELSE 'not found' END AS tier,
 CASE WHEN firm_all >= {fk} THEN 'firm' WHEN check_all >= {ck} THEN 'check' ELSE 'not found' END AS tier_all FROM (
 SELECT run_id, recording_id, species_key, coalesce(f.s, 0) AS firm_shown, coalesce(f.a, 0) AS firm_all, coalesce(c.s, 0) AS check_shown, coalesce(c.a, 0) AS check_all FROM
 (SELECT run_id, recording_id, species_key, {s} AS s, {a} AS a FROM {src} WHERE floor = 0.9) f FULL JOIN
 (SELECT run_id, recording_id, species_key, {s} AS s, {a} AS a FROM {src} WHERE floor = 0.5) c USING (run_id, recording_id, species_key))"""


cte("tiers_", f"SELECT * FROM ({_tiers_sql(2, 2)}) WHERE tier_all <> 'not found'")
_OUTCOME = """CASE WHEN tier = 'firm' AND ann THEN 'firm, right' WHEN tier = 'firm' AND j THEN 'firm, wrong' WHEN tier = 'firm' THEN 'firm, can''t judge'
 WHEN tier = 'check' AND ann THEN 'check, real' WHEN tier = 'check' AND j THEN 'check, not there' WHEN tier = 'check' THEN 'check, can''t judge'
 WHEN ann AND tier_all <> 'not found' THEN 'filter hid a real bird' WHEN ann THEN 'missed' END"""
cte("s_out", f"""SELECT *, {_OUTCOME} AS outcome FROM (SELECT run_id, recording_id, species_key, coalesce(tier, 'not found') AS tier, coalesce(tier_all, 'not found') AS tier_all,
 coalesce(ann, false) AS ann, species_key IN (SELECT species_key FROM label_set) AS j FROM tiers_ FULL JOIN (SELECT run_id, recording_id, species_key, true AS ann FROM truth, runs)
 USING (run_id, recording_id, species_key))""")


def tiers(spark, d, rule=RULE, spans=()):
    return sv.tiers(ev(spark, d, spans), rule, ARM)


@query("V6_tiers", "SELECT run_id, recording_id, species_key, firm_shown, firm_all, check_shown, check_all, tier, tier_all FROM tiers_")
def v6(spark, d):
    return tiers(spark, d).select(*ARM, "recording_id", "species_key", *big("firm_shown", "firm_all", "check_shown", "check_all"), "tier", "tier_all")


@query("V6_tiers_within_span", f"SELECT run_id, recording_id, species_key, tier, tier_all FROM ({_tiers_sql(3, 1, 'span_evid', 'w_all', 'w_shown')}) WHERE tier_all <> 'not found'")
def v6s(spark, d):
    return tiers(spark, d, SPAN_RULE, (86400.0,)).select(*ARM, "recording_id", "species_key", "tier", "tier_all")


@query("V7_truth_pairs", "SELECT * FROM truth")
def v7(spark, d):
    return truth(spark, d)


def outcomes(spark, d):
    return sv.outcomes(tiers(spark, d), truth_by_run(spark, d), ARM, label_set(spark, d))


@query("V8_outcomes", "SELECT run_id, recording_id, species_key, tier, tier_all, outcome FROM s_out WHERE outcome IS NOT NULL")
def v8(spark, d):
    return outcomes(spark, d).select(*ARM, "recording_id", "species_key", "tier", "tier_all", "outcome")


_PIV = ", ".join("count(*) FILTER (outcome = '" + o.replace("'", "''") + f"') AS {c}" for o, c in sv.COL.items())
cte("s_rec", f"SELECT r.run_id, e.recording_id, 72.0::DOUBLE AS hours, {_PIV} FROM v_rec e CROSS JOIN runs r LEFT JOIN s_out o ON o.run_id = r.run_id AND o.recording_id = e.recording_id GROUP BY 1, 2")


def assessed(spark, d):
    return sv.per_recording(outcomes(spark, d), recs_by_run(spark, d), ARM)


@query("V9_per_recording", f"SELECT run_id, recording_id, {', '.join(sv.OUT)} FROM s_rec")
def v9(spark, d):
    return assessed(spark, d).select(*ARM, "recording_id", *big(*sv.OUT))


def stats_sql(p: str = "", n: str = "n_recs", h: str = "hours") -> dict[str, str]:
    fr, fw, _, cr, cw, cu, hid, miss = (p + c for c in sv.OUT)
    ann = f"({fr} + {cr} + {miss} + {hid})"
    return {"firm_precision": f"{fr} / nullif({fr} + {fw}, 0)", "recall_reviewed": f"({fr} + {cr}) / nullif{ann[:-1]}, 0)",
            "firm_recall": f"{fr} / nullif{ann[:-1]}, 0)", "checks_per_recording": f"({cr} + {cw} + {cu}) / {n}",
            "checks_per_hour": f"({cr} + {cw} + {cu}) / {h}", "check_yield": f"{cr} / nullif({cr} + {cw}, 0)",
            "firm_errors_per_recording": f"{fw} / {n}"}


_SUMS = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in sv.OUT)
_ST = ", ".join(f"round({e}, 6) AS {s}" for s, e in stats_sql().items())


def score_sql(src: str, keys: str) -> str:
    return f"SELECT {keys}, {_ST}, n_recs::BIGINT AS n_recordings, round(hours, 6) AS hours FROM (SELECT {keys}, {_SUMS}, count(*) AS n_recs, sum(hours) AS hours FROM {src} GROUP BY {keys})"


def _score_out(df, *keys):
    return df.select(*keys, *r6(*sv.STATS), *big("n_recordings"), *r6("hours"))


@query("V10_score", score_sql("s_rec", "run_id"))
def v10(spark, d):
    return _score_out(sv.score(assessed(spark, d), ARM), *ARM)


_POIS = " + ".join(f"CASE WHEN u > {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in POISSON_1)
cte("s_draw", f"""SELECT rep, recording_id, {_POIS} AS w FROM (SELECT rep, recording_id,
 CAST('0x' || substr(md5('0:' || rep || ':' || recording_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM (SELECT DISTINCT recording_id FROM v_rec), range(0, {N_BOOT}) t(rep))""")
cte("s_sums", f"""SELECT run_id, rep, {', '.join(f'{e} AS {s}' for s, e in stats_sql().items())} FROM (SELECT run_id, rep, {', '.join(f'sum({c} * w)::DOUBLE AS {c}' for c in sv.OUT)},
 sum(w) AS n_recs, sum(hours * w) AS hours FROM s_rec JOIN s_draw USING (recording_id) WHERE w > 0 GROUP BY 1, 2)""")


@query("V11_assess_bootstrap", " UNION ALL ".join(f"SELECT run_id, '{s}' AS stat, round(quantile_cont({s}, 0.025), 6) AS lo, round(quantile_cont({s}, 0.975), 6) AS hi FROM s_sums GROUP BY 1"
                                                  for s in sv.STATS))
def v11(spark, d):
    per = sv.assess(ev(spark, d), RULE, truth_by_run(spark, d), recs_by_run(spark, d), ARM, label_set(spark, d))
    return sv.bootstrap(per, ARM, N_BOOT).select(*ARM, "stat", *r6("lo", "hi"))


@query("V12_paired", " UNION ALL ".join(f"""SELECT '{s}' AS stat, round(quantile_cont(a.{s} - b.{s}, 0.025), 6) AS lo, round(quantile_cont(a.{s} - b.{s}, 0.975), 6) AS hi
 FROM s_sums a JOIN s_sums b USING (rep) WHERE a.run_id = 'runA' AND b.run_id = 'runB'""" for s in sv.STATS))
def v12(spark, d):
    p = assessed(spark, d)
    return sv.paired(p.where("run_id = 'runA'"), p.where("run_id = 'runB'"), N_BOOT).select("stat", *r6("lo", "hi"))


def sweep_sql(evid: str, uni: str, keys: str, n_recs: str, ck: int = 2) -> str:
    """Every cell evaluated directly on every (recording, species)."""
    k = f"{keys}, recording_id, species_key"
    ks = keys.split(", ")[0]
    return f"""WITH cnt AS (SELECT u.*, f.floor, coalesce(e.n_all, 0) AS a, coalesce(e.n_shown, 0) AS s FROM {uni} u CROSS JOIN floors f LEFT JOIN {evid} e USING ({k}, floor)),
 cell AS (SELECT {', '.join('f.' + x.strip() for x in keys.split(','))}, f.ann, f.j, f.floor, c.floor AS check_floor, ks.k, f.s >= ks.k AS firm, NOT f.s >= ks.k AND c.s >= least({ck}, ks.k) AS chk,
  f.a >= ks.k OR c.a >= least({ck}, ks.k) AS seen FROM cnt f JOIN cnt c USING ({k}) CROSS JOIN ks WHERE f.floor IN (SELECT floor FROM ffloors) AND c.floor <= f.floor),
 agg AS (SELECT {keys}, floor, check_floor, k, count(*) FILTER (firm AND ann)::DOUBLE AS firm_right, count(*) FILTER (firm AND NOT ann AND j)::DOUBLE AS firm_wrong,
  count(*) FILTER (firm AND NOT ann AND NOT j)::DOUBLE AS firm_cant_judge, count(*) FILTER (chk AND ann)::DOUBLE AS check_real, count(*) FILTER (chk AND NOT ann AND j)::DOUBLE AS check_not_there,
  count(*) FILTER (chk AND NOT ann AND NOT j)::DOUBLE AS check_cant_judge, count(*) FILTER (NOT firm AND NOT chk AND ann AND seen)::DOUBLE AS filter_hid_a_real_bird,
  count(*) FILTER (NOT firm AND NOT chk AND ann AND NOT seen)::DOUBLE AS missed, any_value(n.n_recs)::DOUBLE AS n_recs, any_value(n.n_recs) * 72.0::DOUBLE AS hours
  FROM cell JOIN ({n_recs}) n USING ({keys}) GROUP BY {keys}, floor, check_floor, k)
 SELECT {keys}, check_floor, floor, k, {', '.join(f'{e} AS {s}' for s, e in stats_sql().items())} FROM agg"""


cte("s_uni", """SELECT run_id, recording_id, species_key, (recording_id, species_key) IN (SELECT (recording_id, species_key) FROM truth) AS ann,
 species_key IN (SELECT species_key FROM label_set) AS j FROM (SELECT run_id, recording_id, species_key FROM evid UNION SELECT run_id, recording_id, species_key FROM truth, runs)""")
cte("s_sweep", sweep_sql("evid", "s_uni", "run_id", "SELECT run_id, count(*) AS n_recs FROM v_rec, runs GROUP BY 1"))


def sweep(spark, d):
    return tb.stored(spark, d, "sweep", lambda: sv.sweep(
        ev(spark, d), RULE, truth_by_run(spark, d), recs_by_run(spark, d), ARM, label_set(spark, d)))


CELL = ("check_floor", "floor")
_SW = ", ".join(f"round({s}, 6) AS {s}" for s in sv.STATS)


def _cells(df, *keys):
    return df.select(*keys, *CELL, *big("k"), *r6(*sv.STATS))


@query("V13_sweep", f"SELECT run_id, check_floor, floor, k::BIGINT AS k, {_SW} FROM s_sweep")
def v13(spark, d):
    return _cells(sweep(spark, d), *ARM)


FEAS = "firm_precision >= 0.6 AND checks_per_recording <= 4.0"
PREF = "recall_reviewed DESC NULLS LAST, checks_per_recording, floor DESC, check_floor DESC, k"


@query("V14_best", f"SELECT run_id, check_floor, floor, k::BIGINT AS k, {_SW} FROM s_sweep WHERE {FEAS} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {PREF}) = 1")
def v14(spark, d):
    return _cells(sv.best(sweep(spark, d), CONS, ARM), *ARM)


def shared_sql(src: str, keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT * FROM (SELECT {lead}check_floor, floor, k, {', '.join(f'avg({s}) AS {s}' for s in sv.STATS)} FROM {src} GROUP BY {lead}check_floor, floor, k
 HAVING count(*) FILTER ({FEAS}) = 2) QUALIFY row_number() OVER ({part} ORDER BY {PREF}) = 1"""


@query("V15_best_shared", f"SELECT check_floor, floor, k::BIGINT AS k, {_SW} FROM ({shared_sql('s_sweep', '')})")
def v15(spark, d):
    return _cells(sv.best_shared(sweep(spark, d), CONS, [], "run_id", 2))


@query("V16_split", """SELECT recording_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || recording_id), recording_id) <= round_even((count(*) OVER ()) * 0.4, 0) THEN 'test' ELSE 'tune' END AS side FROM e_rec""")
def v16(spark, d):
    return sv.split(tb.recordings(spark, d), 7, 0.4)


# ------------------------------------------------------------------ held out: every visit is left out in turn
cte("v_al", f"SELECT * REPLACE ({_AT} AS recording_id) FROM e_al")
cte("vt_all", "SELECT run_id, species_key, score, sum(y_true)::BIGINT AS p, count(*)::BIGINT AS n FROM v_al GROUP BY ALL")
cte("vt_own", "SELECT run_id, species_key, recording_id AS fold, score, sum(y_true)::BIGINT AS p, count(*)::BIGINT AS n FROM v_al GROUP BY ALL")
cte("vt_left", """SELECT a.run_id, f.recording_id AS fold, a.species_key, a.score, a.p - coalesce(o.p, 0) AS p, a.n - coalesce(o.n, 0) AS n FROM vt_all a CROSS JOIN v_rec f
 LEFT JOIN vt_own o ON o.run_id = a.run_id AND o.species_key = a.species_key AND o.score = a.score AND o.fold = f.recording_id""", keep=True)


def _left_curve(keys: str, src: str) -> str:
    return f"""SELECT {keys}, score AS theta, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, sum(p) OVER (PARTITION BY {keys}) AS n_pos,
 (sum(p) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE AS precision, sum(p) OVER w AS recall FROM ({src}) WHERE n > 0 WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)"""


cte("f_curve", _left_curve("run_id, fold, species_key", "SELECT * FROM vt_left"))
cte("f_micro", _left_curve("run_id, fold", "SELECT run_id, fold, score, sum(p) AS p, sum(n) AS n FROM vt_left GROUP BY ALL"), keep=True)
_DEEPEST = "max(CASE WHEN n_pos > 0 AND precision >= floor AND tp + fp >= 10 THEN {'r': recall, 't': theta} END).t"
cte("f_bars", f"""SELECT run_id, fold, floor, species_key, CASE WHEN n_pos >= 10 AND own IS NOT NULL THEN own ELSE fb END AS theta FROM
 (SELECT run_id, fold, species_key, floor, any_value(n_pos) AS n_pos, {_DEEPEST} AS own FROM f_curve, floors GROUP BY ALL)
 JOIN (SELECT run_id, fold, floor, {_DEEPEST} AS fb FROM f_micro, floors GROUP BY ALL) USING (run_id, fold, floor)""", keep=True)
cte("f_det", f"SELECT run_id, recording_id, species_key, score, count(*) AS a, count(*) FILTER (NOT implausible) AS s FROM v_det d WHERE {RE} GROUP BY ALL")
cte("f_evid", """SELECT d.run_id, b.fold, d.recording_id, d.species_key, b.floor, sum(a)::BIGINT AS n_all, sum(s)::BIGINT AS n_shown FROM f_det d JOIN f_bars b USING (run_id, species_key)
 WHERE d.score >= b.theta GROUP BY ALL""", keep=True)
# counts clipped where no cell tells them apart, then pairs with the same counts together: 81 floor pairs for each, and every count on top
_ROOM = [f"p{f:g}".replace(".", "_") for f in FLOORS]
_WIDE = ", ".join(f"coalesce(max(least(n_all, 50)) FILTER (floor = {f!r}), 0) AS a_{n}, coalesce(max(least(n_shown, 50)) FILTER (floor = {f!r}), 0) AS s_{n}" for f, n in zip(FLOORS, _ROOM))
cte("f_uni", f"""SELECT run_id, fold, (recording_id, species_key) IN (SELECT (recording_id, species_key) FROM truth) AS ann, species_key IN (SELECT species_key FROM label_set) AS j, {_WIDE}
 FROM (SELECT run_id, fold, recording_id, species_key, floor, n_all, n_shown FROM f_evid UNION ALL SELECT run_id, f.recording_id, t.recording_id, species_key, NULL, NULL, NULL FROM truth t, runs, v_rec f)
 WHERE recording_id <> fold GROUP BY run_id, fold, recording_id, species_key""", keep=True)
cte("f_hist", " UNION ALL ".join(
    f"SELECT run_id, fold, ann, j, {f!r}::DOUBLE AS floor, {c!r}::DOUBLE AS check_floor, s_{n} AS fs, a_{n} AS fa, least(s_{m}, 2) AS cs, least(a_{m}, 2) AS ca, count(*) AS w FROM f_uni GROUP BY ALL"
    for f, n in zip(FLOORS, _ROOM) if f in FIRM_FLOORS for c, m in zip(FLOORS, _ROOM) if c <= f), keep=True)
cte("f_cell", """SELECT run_id, fold, floor, check_floor, k, ann, j, w, fs >= k AS firm, NOT fs >= k AND cs >= least(2, k) AS chk, fa >= k OR ca >= least(2, k) AS seen FROM f_hist, ks""")
_CELL_SUMS = {"firm_right": "firm AND ann", "firm_wrong": "firm AND NOT ann AND j", "firm_cant_judge": "firm AND NOT ann AND NOT j", "check_real": "chk AND ann", "check_not_there": "chk AND NOT ann AND j",
              "check_cant_judge": "chk AND NOT ann AND NOT j", "filter_hid_a_real_bird": "NOT firm AND NOT chk AND ann AND seen", "missed": "NOT firm AND NOT chk AND ann AND NOT seen"}
cte("f_sweep", f"""SELECT run_id, fold, check_floor, floor, k, {', '.join(f'{e} AS {s}' for s, e in stats_sql().items())} FROM (SELECT run_id, fold, check_floor, floor, k,
 {', '.join(f'coalesce(sum(w) FILTER ({c}), 0)::DOUBLE AS {o}' for o, c in _CELL_SUMS.items())}, ((SELECT count(*) FROM v_rec) - 1)::DOUBLE AS n_recs, ((SELECT count(*) FROM v_rec) - 1) * 72.0::DOUBLE AS hours
 FROM f_cell GROUP BY ALL)""", keep=True)
cte("f_own", f"SELECT * FROM f_sweep WHERE {FEAS} QUALIFY row_number() OVER (PARTITION BY run_id, fold ORDER BY {PREF}) = 1")
cte("f_shared", shared_sql("f_sweep", "fold"))


def _held_sql(picks: str) -> str:
    """Held-out per-recording counts at each fold's chosen cell."""
    return f"""SELECT r.run_id, e.recording_id, 72.0::DOUBLE AS hours, {_PIV} FROM v_rec e CROSS JOIN runs r LEFT JOIN (SELECT *, {_OUTCOME} AS outcome FROM (
 SELECT run_id, recording_id, species_key, coalesce(tier, 'not found') AS tier, coalesce(tier_all, 'not found') AS tier_all, coalesce(ann, false) AS ann,
 species_key IN (SELECT species_key FROM label_set) AS j FROM (SELECT *, CASE WHEN fs >= k THEN 'firm' WHEN cs >= least(2, k) THEN 'check' ELSE 'not found' END AS tier,
  CASE WHEN fa >= k THEN 'firm' WHEN ca >= least(2, k) THEN 'check' ELSE 'not found' END AS tier_all FROM (SELECT v.run_id, v.recording_id, v.species_key, any_value(p.k) AS k,
  coalesce(max(n_shown) FILTER (v.floor = p.floor), 0) AS fs, coalesce(max(n_all) FILTER (v.floor = p.floor), 0) AS fa, coalesce(max(n_shown) FILTER (v.floor = p.check_floor), 0) AS cs,
  coalesce(max(n_all) FILTER (v.floor = p.check_floor), 0) AS ca FROM f_evid v JOIN ({picks}) p ON p.run_id = v.run_id AND p.fold = v.fold WHERE v.recording_id = v.fold GROUP BY 1, 2, 3))
 FULL JOIN (SELECT run_id, recording_id, species_key, true AS ann FROM truth, runs) USING (run_id, recording_id, species_key))) o ON o.run_id = r.run_id AND o.recording_id = e.recording_id GROUP BY 1, 2"""


cte("h_own", _held_sql("SELECT run_id, fold, check_floor, floor, k FROM f_own"))
cte("h_shared", _held_sql("SELECT run_id, fold, check_floor, floor, k FROM f_shared, runs"))
_HELD: dict = {}


def forget_held_out():
    """Forget the held-out assessment, so that the next call computes it again (bench)."""
    _HELD.clear()


def folds(spark, d):
    """Every visit is a fold of its own."""
    return recordings(spark, d).select("recording_id", F.col("recording_id").alias("fold"))


def visit_aligned(spark, d):
    return visits(tb.aligned(spark, d))


def held(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _HELD:
        _HELD[key] = ho.held_out(visit_aligned(spark, d), detections(spark, d), folds(spark, d), RULE, SPEC, truth(spark, d), recs(spark, d), CONS, label_set(spark, d), MODELS)
    return _HELD[key]


@query("V1_fold_refit_bars", "SELECT run_id, fold, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, species_key, round(theta, 6) AS theta FROM f_bars")
def v1(spark, d):
    every = folds(spark, d)
    bars = ho.held_out_bars(ho.fold_ties(visit_aligned(spark, d), [*ARM, "species_key"], every), ARM, every.select("fold"), every.count(), SPEC)
    named = F.arrays_zip(F.array(*[F.lit(f"p{f:g}") for f in FLOORS]).alias("bar"), F.col("thetas").alias("theta"))
    return bars.where("species_key is not null").select(*ARM, "fold", "species_key", F.inline(named).alias("bar", "theta")).select(*ARM, "fold", "bar", "species_key", *r6("theta"))


@query("V17_held_out_own", score_sql("h_own", "run_id"))
def v17(spark, d):
    return _score_out(sv.score(held(spark, d)["held_own"], ARM), *ARM)


@query("V17_held_out_shared", score_sql("h_shared", "run_id"))
def v17s(spark, d):
    return _score_out(sv.score(held(spark, d)["held_shared"], ARM), *ARM)


@query("V17_picks", "SELECT run_id, fold, check_floor, floor, k::BIGINT AS k FROM f_own")
def v17p(spark, d):
    return held(spark, d)["own"].select(*ARM, "fold", *CELL, *big("k"))


@query("V18_stability", f"""SELECT run_id, n AS rounds, (n - count(*))::BIGINT AS none, count(*) FILTER (o.floor = b.floor AND o.check_floor = b.check_floor AND o.k = b.k) AS same,
 min(o.floor) AS floor_min, max(o.floor) AS floor_max, min(o.check_floor) AS check_floor_min, max(o.check_floor) AS check_floor_max, min(o.k)::BIGINT AS k_min, max(o.k)::BIGINT AS k_max
 FROM f_own o LEFT JOIN (SELECT * FROM s_sweep WHERE {FEAS} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {PREF}) = 1) b USING (run_id), (SELECT count(*) AS n FROM v_rec) GROUP BY run_id, n""")
def v18(spark, d):
    s = sv.stability(held(spark, d)["own"], sv.best(sweep(spark, d), CONS, ARM), ARM, folds(spark, d).count())
    return s.select(*ARM, *big("rounds", "none", "same"), "floor_min", "floor_max", "check_floor_min", "check_floor_max", *big("k_min", "k_max"))


HARD = Constraints(min_firm_precision=0.6, max_checks_per_recording=0.1, min_recall_reviewed=0.999)


@query("V19_infeasible_relaxed", f"""SELECT run_id, relaxed, check_floor, floor, k::BIGINT AS k FROM (
 SELECT *, 0 AS i, 'none' AS relaxed FROM s_sweep WHERE firm_precision >= 0.6 AND checks_per_recording <= 0.1 AND recall_reviewed >= 0.999
 UNION ALL SELECT *, 1, 'checks' FROM s_sweep WHERE firm_precision >= 0.6 AND recall_reviewed >= 0.999 UNION ALL SELECT *, 2, 'checks, recall' FROM s_sweep WHERE firm_precision >= 0.6
 UNION ALL SELECT *, 3, 'checks, recall, precision' FROM s_sweep) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i, {PREF}) = 1""")
def v19(spark, d):
    return sv.relaxed(sweep(spark, d), HARD, ARM).select(*ARM, "relaxed", *CELL, *big("k"))


# the rule, the best cell, and the one-detection list at one bar, as three assessments
@query("V20_report", f"""SELECT run_id, 'rule' AS entry, round(recall_reviewed, 6) AS recall_reviewed, round(firm_precision, 6) AS firm_precision FROM ({score_sql('s_rec', 'run_id')})
 UNION ALL SELECT run_id, 'own best', round(recall_reviewed, 6), round(firm_precision, 6) FROM (SELECT * FROM s_sweep WHERE {FEAS} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {PREF}) = 1)
 UNION ALL SELECT run_id, 'one detection', round(recall_reviewed, 6), round(firm_precision, 6) FROM s_sweep WHERE floor = 0.9 AND check_floor = 0.9 AND k = 1""")
def v20(spark, d):
    e, t, r, ls = ev(spark, d), truth_by_run(spark, d), recs_by_run(spark, d), label_set(spark, d)
    one = SurveyRule(Condition(0.9, 1), Condition(0.9, 1))
    rule = sv.score(sv.assess(e, RULE, t, r, ARM, ls), ARM).select(*ARM, F.lit("rule").alias("entry"), *r6("recall_reviewed", "firm_precision"))
    base = sv.score(sv.assess(e, one, t, r, ARM, ls), ARM).select(*ARM, F.lit("one detection").alias("entry"), *r6("recall_reviewed", "firm_precision"))
    own = sv.best(sv.sweep(e, RULE, t, r, ARM, ls), CONS, ARM).select(*ARM, F.lit("own best").alias("entry"), *r6("recall_reviewed", "firm_precision"))
    return rule.unionByName(own).unionByName(base)


cte("v_recall", f"SELECT run_id, {stats_sql()['recall_reviewed']} AS r FROM (SELECT run_id, {_SUMS} FROM s_rec GROUP BY 1)")


@query("V21_winner", f"""SELECT a.run_id AS winner, x.rival, round(x.diff, 6) AS diff, round(quantile_cont(x.d, 0.025), 6) AS lo, round(quantile_cont(x.d, 0.975), 6) AS hi FROM
 (SELECT * FROM ({score_sql('s_rec', 'run_id')}) WHERE firm_precision >= 0.1 ORDER BY recall_reviewed DESC, run_id LIMIT 1) a JOIN
 (SELECT p.run_id, q.run_id AS rival, pp.r - qq.r AS diff, p.recall_reviewed - q.recall_reviewed AS d FROM s_sums p JOIN s_sums q ON p.rep = q.rep AND p.run_id <> q.run_id
  JOIN v_recall pp ON pp.run_id = p.run_id JOIN v_recall qq ON qq.run_id = q.run_id) x ON x.run_id = a.run_id GROUP BY ALL""")
def v21(spark, d):
    """The best model that keeps the limits, with its paired interval against every other one."""
    w = sv.winner(assessed(spark, d), "run_id", Constraints(min_firm_precision=0.1), N_BOOT)
    return w.where("stat = 'recall_reviewed'").select("winner", F.col("run_id").alias("rival"), *r6("diff", "lo", "hi"))


@query("V22_rarely_firm", """SELECT species_key, count(*) FILTER (run_id = 'runA' AND tier = 'firm') AS firm_a, count(*) FILTER (run_id = 'runA' AND tier = 'check') AS check_a,
 count(*) FILTER (run_id = 'runA' AND outcome = 'missed') AS missed_a, count(*) FILTER (run_id = 'runB' AND tier = 'firm') AS firm_b, count(*) FILTER (run_id = 'runB' AND tier = 'check') AS check_b,
 count(*) FILTER (run_id = 'runB' AND outcome = 'missed') AS missed_b FROM s_out WHERE outcome IS NOT NULL GROUP BY 1""")
def v22(spark, d):
    p = outcomes(spark, d).groupBy("species_key").pivot("run_id", MODELS).agg(
        F.count_if(F.col("tier") == "firm").alias("firm"), F.count_if(F.col("tier") == "check").alias("check"), F.count_if(F.col("outcome") == "missed").alias("missed"))
    names = [(f"{m}_{x}", f"{x}_{m[-1].lower()}") for m in MODELS for x in ("firm", "check", "missed")]
    return p.select("species_key", *[F.coalesce(F.col(a), F.lit(0)).cast("long").alias(b) for a, b in names])


@query("V23_unlabelled_lists", "SELECT recording_id, species_key, max(tier) FILTER (run_id = 'runA') AS run_a, max(tier) FILTER (run_id = 'runB') AS run_b FROM tiers_ GROUP BY 1, 2")
def v23(spark, d):
    p = tiers(spark, d).groupBy("recording_id", "species_key").pivot("run_id", MODELS).agg(F.first("tier"))
    return p.select("recording_id", "species_key", F.col("runA").alias("run_a"), F.col("runB").alias("run_b"))


# ------------------------------------------------------------------ setups
@query("N1_bars_payload", "SELECT run_id, species_key, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, round(theta, 6) AS theta FROM bars WHERE floor IN (0.5, 0.9) AND theta IS NOT NULL")
def n1(spark, d):
    return bars(spark, d).where(F.col("bar").isin(sv.bar_of(RULE.check), sv.bar_of(RULE.firm)) & F.col("species_key").isNotNull() & F.col("theta").isNotNull()).select(
        *ARM, "species_key", "bar", *r6("theta"))


@query("N2_claim", f"""SELECT run_id, run_id || ': firm after 2 detections at p0.9, checked after 2 at p0.5. Measured on ' || n_recordings || ' recording(s) (' || printf('%.1f', hours)
 || ' h): firm calls right ' || coalesce(printf('%.0f', firm_precision * 100) || '%', '—') || ', birds found after checking ' || coalesce(printf('%.0f', recall_reviewed * 100) || '%', '—') AS claim
 FROM ({score_sql('s_rec', 'run_id')})""")
def n2(spark, d):
    from chorale.operators.setups import claim
    return claim(sv.score(assessed(spark, d), ARM), RULE, "run_id").select(*ARM, "claim")


@query("N3_apply", """SELECT run_id, recording_id, species_key, CASE WHEN lab THEN 'present' ELSE tier END AS listed, CASE WHEN r.labelled AND lab THEN 'labelled' WHEN lab THEN 'labelled (part of recording)'
 ELSE 'model output' END AS source, tier AS model_tier, fa AS firm_bar_detections, ca AS check_bar_detections FROM (
 SELECT run_id, recording_id, species_key, coalesce(tier, 'not found') AS tier, coalesce(firm_all, 0) AS fa, coalesce(check_all, 0) AS ca, coalesce(lab, false) AS lab FROM
 (SELECT * FROM tiers_ WHERE tier <> 'not found') FULL JOIN (SELECT DISTINCT run_id, recording_id, species_key, true AS lab FROM v_ann a JOIN v_rec USING (recording_id), runs WHERE labelled)
 USING (run_id, recording_id, species_key)) JOIN (SELECT recording_id, labelled FROM v_rec) r USING (recording_id) WHERE NOT r.labelled OR lab""")
def n3(spark, d):
    from chorale.operators.align import imported_truth
    t = imported_truth(recordings(spark, d), annotations(spark, d))
    t["annotations"] = t["annotations"].withColumn("run_id", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return sv.apply_setup(tiers(spark, d), t, ARM).select(*ARM, "recording_id", "species_key", "listed", "source", "model_tier", *big("firm_bar_detections", "check_bar_detections"))


@query("N4_usable_setups", """SELECT DISTINCT run_id FROM (SELECT run_id, count(DISTINCT recording_id) AS n FROM e_win GROUP BY 1) WHERE n = (SELECT count(*) FROM e_rec)""")
def n4(spark, d):
    from chorale.operators.setups import usable
    setups = tb.scored(spark, d).select(F.col("run_id").alias("model")).distinct()
    runs = tb.score_windows(spark, d).select("run_id", "recording_id").withColumn("identity", F.col("run_id"))
    return usable(setups, runs, tb.recordings(spark, d)).select(F.col("model").alias("run_id"))
