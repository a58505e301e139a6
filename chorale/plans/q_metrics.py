"""Queries of the metrics family: sweeps, rules, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.operators import curves as cv
from chorale.operators import prefix
from chorale.operators.curves import rule_column, rule_name
from chorale.params import DEFAULT_RULES, Rule
from chorale.plans import testbed as tb
from chorale.plans.registry import big, cte, query, r6

CURVE = ("theta", "precision", "recall")
N = ("tp", "fp", "fn")


def _curve_cols(extra=""):
    return f"""{extra} round(theta, 6) AS theta, tp::BIGINT AS tp, fp::BIGINT AS fp, (n_pos - tp)::BIGINT AS fn,
 round(precision, 6) AS precision, round(recall, 6) AS recall"""


@query("J1_pr_curve", f"SELECT {_curve_cols('species_key,')} FROM l_curve")
def j1(spark, d):
    c = cv.pr_curve(tb.line_aligned(spark, d), ["species_key"])
    return c.select("species_key", *r6(*CURVE), *big(*N))


@query("J2_average_precision", """SELECT species_key, max(n_pos)::BIGINT AS n_positive, max(n_all)::BIGINT AS n_windows,
 round(sum(dp * precision) / max(n_pos), 6) AS ap FROM d_curve GROUP BY 1""")
def j2(spark, d):
    c = cv.pr_curve(tb.document_aligned(spark, d), ["species_key"])
    return cv.average_precision(c, ["species_key"]).select("species_key", *big("n_positive", "n_windows"), *r6("ap"))


_F = "CASE WHEN {b}*precision + recall > 0 THEN precision*(1+{b})*recall/({b}*precision+recall) ELSE 0 END"


def rule_sql(src: str, keys: str, rule: Rule) -> str:
    """The chosen point of one rule per key: best merit, then highest theta."""
    if rule.kind == "fbeta":
        merit, ok = _F.format(b=float(rule.value ** 2)), "true"
    elif rule.kind == "precision":
        merit, ok = "recall", f"precision >= {rule.value}"
    else:
        merit, ok = "precision", f"recall >= {rule.value}"
    lead = f"{keys}," if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {lead} theta, precision, recall, tp, fp, n_pos - tp AS fn FROM {src}
 WHERE tp + fp >= {rule.min_support} AND n_pos > 0 AND {ok}
 QUALIFY row_number() OVER ({part} ORDER BY {merit} DESC, theta DESC) = 1"""


def rules_sql(src: str, rules) -> str:
    parts = []
    for r in rules:
        best = "recall" if r.kind == "recall" else "precision"
        miss = (f"'no point predicts ≥ {r.min_support} windows'" if r.kind == "fbeta" else
                f"'{r.kind} never reaches {r.value:g} (best ' || coalesce(printf('%.3f', b.best), 'nan') || ')'")
        parts.append(f"""SELECT k.species_key, '{rule_name(r)}' AS rule, round(x.theta, 6) AS theta, round(x.precision, 6) AS precision,
 round(x.recall, 6) AS recall, round(CASE WHEN x.theta IS NOT NULL THEN CASE WHEN x.precision + x.recall > 0 THEN
 2 * x.precision * x.recall / (x.precision + x.recall) ELSE 0 END END, 6) AS f1, coalesce(x.tp, 0)::BIGINT AS tp, coalesce(x.fp, 0)::BIGINT AS fp,
 coalesce(x.fn, k.n_pos)::BIGINT AS fn, x.theta IS NOT NULL AS feasible,
 CASE WHEN x.theta IS NOT NULL THEN '' WHEN k.n_pos = 0 THEN 'no positives in the evaluation set' ELSE {miss} END AS reason
 FROM (SELECT species_key, max(n_pos) AS n_pos FROM {src} GROUP BY 1) k
 LEFT JOIN ({rule_sql(src, 'species_key', r)}) x USING (species_key)
 LEFT JOIN (SELECT species_key, max({best}) AS best FROM {src} WHERE tp + fp >= {r.min_support} GROUP BY 1) b USING (species_key)""")
    return "\nUNION ALL\n".join(parts)


RULES4 = (*DEFAULT_RULES, Rule("recall", 0.5))


@query("J3_apply_rule", rules_sql("d_curve", RULES4))
def j3(spark, d):
    c = cv.pr_curve(tb.document_aligned(spark, d), ["species_key"])
    return cv.rule_rows(c, ["species_key"], RULES4).select(
        "species_key", "rule", *r6("theta", "precision", "recall", "f1"), *big(*N), "feasible", "reason")


@query("J4_species_curves", f"""SELECT run_id, {_curve_cols('species_key,')} FROM e_curve""")
def j4(spark, d):
    c = cv.pr_curve(tb.aligned(spark, d), ["run_id", "species_key"])
    return c.select("run_id", "species_key", *r6(*CURVE), *big(*N))


def _per_species_sql(src: str) -> str:
    joins = "".join(f" LEFT JOIN ({rule_sql(src, 'species_key', r)}) {rule_column(r)} USING (species_key)" for r in DEFAULT_RULES)
    cols = ", ".join(f"round({rule_column(r)}.{c}, 6) AS {c}_{rule_column(r)}" for r in DEFAULT_RULES for c in CURVE)
    feas = ", ".join(f"{rule_column(r)}.theta IS NOT NULL AS feasible_{rule_column(r)}" for r in DEFAULT_RULES)
    return f"""SELECT species_key, k.n_positive::BIGINT AS n_positive, k.n_windows::BIGINT AS n_windows,
 round(k.n_positive / k.n_windows, 6) AS prevalence, round(k.ap, 6) AS ap, {cols}, {feas}
 FROM (SELECT species_key, max(n_pos) AS n_positive, max(n_all) AS n_windows, sum(dp * precision) / max(n_pos) AS ap
 FROM {src} GROUP BY 1) k{joins}"""


@query("J5_per_species_table", _per_species_sql("l_curve"))
def j5(spark, d):
    t = cv.per_species_table(cv.pr_curve(tb.line_aligned(spark, d), ["species_key"]), ["species_key"])
    num = [f"{c}_{rule_column(r)}" for r in DEFAULT_RULES for c in CURVE]
    return t.select("species_key", *big("n_positive", "n_windows"), *r6("prevalence", "ap", *num),
                    *[f"feasible_{rule_column(r)}" for r in DEFAULT_RULES])


cte("e_ap", """SELECT run_id, species_key, max(n_pos) AS n_positive, max(n_all) AS n_windows,
 CASE WHEN max(n_pos) > 0 THEN sum(dp * precision) / max(n_pos) END AS ap FROM e_curve GROUP BY 1, 2""")


@query("J6_cmap", """SELECT run_id, round(avg(ap) FILTER (n_positive >= 100), 6) AS cmap,
 count(*) FILTER (n_positive >= 100 AND ap IS NOT NULL) AS n_species,
 count(*) FILTER (NOT (n_positive >= 100 AND ap IS NOT NULL)) AS n_excluded, 100::BIGINT AS min_positives FROM e_ap GROUP BY 1""")
def j6(spark, d):
    t = cv.average_precision(cv.pr_curve(tb.aligned(spark, d), ["run_id", "species_key"]), ["run_id", "species_key"])
    return cv.cmap(t, ["run_id"], 100).select("run_id", *r6("cmap"), *big("n_species", "n_excluded", "min_positives"))


def _micro_rules(src: str) -> str:
    return "".join(f" LEFT JOIN ({rule_sql(src, 'run_id', r)}) {rule_column(r)} USING (run_id)" for r in DEFAULT_RULES)


SUMMARY_SQL = f"""SELECT run_id, round(c.cmap, 6) AS cmap, c.n_species, c.n_excluded, 1::BIGINT AS min_positives,
 round(m.micro_ap, 6) AS micro_ap, m.n_pairs::BIGINT AS n_pairs, w.n_windows,
 {', '.join(f'round({rule_column(r)}.{c}, 6) AS {c}_{rule_column(r)}' for r in DEFAULT_RULES for c in CURVE)}
 FROM (SELECT run_id, avg(ap) AS cmap, count(ap) AS n_species, count(*) - count(ap) AS n_excluded FROM e_ap GROUP BY 1) c
 JOIN (SELECT run_id, sum(dp * precision) / max(n_pos) AS micro_ap, max(n_all) AS n_pairs FROM e_micro GROUP BY 1) m USING (run_id)
 JOIN (SELECT run_id, count(DISTINCT (recording_id, start_s)) AS n_windows FROM e_al GROUP BY 1) w USING (run_id)
 {_micro_rules('e_micro')}"""


@query("J7_summary", SUMMARY_SQL)
def j7(spark, d):
    s = cv.summary(tb.aligned(spark, d), ["run_id"])
    return s.select("run_id", *r6("cmap", "micro_ap", *[f"{c}_{rule_column(r)}" for r in DEFAULT_RULES for c in CURVE]),
                    *big("n_species", "n_excluded", "min_positives", "n_pairs", "n_windows"))


@query("J7_micro_curve", f"SELECT {_curve_cols()} FROM l_micro")
def j7b(spark, d):
    return cv.pr_curve(tb.line_aligned(spark, d), []).select(*r6(*CURVE), *big(*N))


@query("J8_thin", """SELECT species_key, round(theta, 6) AS theta FROM (
 SELECT *, row_number() OVER (PARTITION BY species_key ORDER BY theta DESC) - 1 AS i, count(*) OVER (PARTITION BY species_key) AS len FROM l_curve)
 WHERE len <= 50 OR i IN (SELECT (j * (len - 1)) // 49 FROM range(0, 50) t(j))""")
def j8(spark, d):
    c = cv.pr_curve(tb.line_aligned(spark, d), ["species_key"])
    return prefix.thin(c, ["species_key"], n=50).select("species_key", *r6("theta"))


@query("J9_curve_frame", """SELECT 'docs' AS arm, species_key, round(theta, 6) AS theta, round(CASE WHEN precision + recall > 0 THEN
 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM d_curve""")
def j9(spark, d):
    c = cv.curve_frame(cv.pr_curve(tb.document_aligned(spark, d), ["species_key"]))
    return c.select(F.lit("docs").alias("arm"), "species_key", *r6("theta", "f1"))


@query("J10_point_at", """SELECT species_key, round(precision, 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall,
 coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp FROM (SELECT DISTINCT species_key FROM l_curve)
 LEFT JOIN (SELECT * FROM l_curve WHERE theta >= 0.77 QUALIFY row_number() OVER (PARTITION BY species_key ORDER BY theta) = 1)
 USING (species_key)""")
def j10(spark, d):
    c = cv.pr_curve(tb.line_aligned(spark, d), ["species_key"])
    return cv.point_at(c, ["species_key"], F.lit(0.77)).select("species_key", *r6("precision", "recall"), *big("tp", "fp"))


@query("J11_prevalence", """SELECT run_id, species_key, round(sum(y_true) / count(*), 6) AS prevalence FROM e_al GROUP BY 1, 2""")
def j11(spark, d):
    t = cv.tie_counts(tb.aligned(spark, d), ["run_id", "species_key"]).groupBy("run_id", "species_key").agg(
        (F.sum("p") / F.sum("n")).alias("prevalence"))
    return t.select("run_id", "species_key", *r6("prevalence"))


@query("B11_rank_resolution", """SELECT species_key, n_positive::BIGINT AS n_positive, k::BIGINT AS top_k,
 round(count(DISTINCT score) / k, 6) AS distinct_fraction FROM (
 SELECT *, row_number() OVER (PARTITION BY species_key ORDER BY score DESC) AS i, least(n, greatest(2 * n_positive, 100)) AS k FROM (
 SELECT species_key, score, sum(y_true) OVER (PARTITION BY species_key) AS n_positive, count(*) OVER (PARTITION BY species_key) AS n FROM l_al))
 WHERE n_positive >= 10 AND i <= k GROUP BY species_key, n_positive, k""")
def b11(spark, d):
    return cv.rank_resolution(tb.line_aligned(spark, d), ["species_key"]).select(
        "species_key", *big("n_positive", "top_k"), *r6("distinct_fraction"))


@query("B11_rank_resolution_summary", """SELECT run_id, round(median(f), 6) AS median_distinct_fraction, count(*) AS n_species,
 median(f) < 0.5 AS damaged FROM (SELECT run_id, species_key, count(DISTINCT score) / k AS f FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, species_key ORDER BY score DESC) AS i, least(n, greatest(2 * p, 100)) AS k FROM (
 SELECT run_id, species_key, score, sum(y_true) OVER (PARTITION BY run_id, species_key) AS p,
 count(*) OVER (PARTITION BY run_id, species_key) AS n FROM e_al)) WHERE p >= 10 AND i <= k GROUP BY run_id, species_key, k) GROUP BY 1""")
def b11s(spark, d):
    t = cv.rank_resolution(tb.aligned(spark, d), ["run_id", "species_key"])
    return cv.rank_resolution_summary(t, ["run_id"]).select("run_id", *r6("median_distinct_fraction"), *big("n_species"), "damaged")
