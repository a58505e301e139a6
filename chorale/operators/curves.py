"""Exact precision-recall sweeps, average precision, and the rules that pick an operating point.

Ties are collapsed before anything is ordered: a curve needs only (key, score) with its counts,
which combine map-side. The cumulative counts then come from ``prefix.running_totals``, so
neither a very common species nor the pooled curve is ordered by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators.prefix import running_totals
from chorale.params import DEFAULT_RULES, RANK_RESOLUTION_FLOOR, Rule
from chorale.session import cut


def tie_counts(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) with ``p`` positives and ``n`` rows."""
    return aligned.groupBy(*keys, F.col("score").cast("float").alias("score")).agg(
        F.sum(F.col("y_true").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))


def curve_from_ties(ties: DataFrame, keys: list[str]) -> DataFrame:
    """One point per distinct score: ``score >= theta`` reproduces its counts exactly."""
    cum = running_totals(ties, keys, "score", {"tp": "p", "seen": "n"})
    tp, seen, pos = F.col("tp"), F.col("seen"), F.col("total_tp")
    return cum.select(
        *keys, F.col("score").cast("double").alias("theta"), "tp", (seen - tp).alias("fp"),
        (pos - tp).alias("fn"), (tp / seen).alias("precision"),
        F.when(pos > 0, tp / pos).alias("recall"),
        pos.alias("n_pos"), (F.col("total_seen") - pos).alias("n_neg"), F.col("p").alias("dp"))


def pr_curve(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return curve_from_ties(tie_counts(aligned, keys), keys)


def fbeta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    den = p * b2 + r
    return F.when(den > 0, p * (1 + b2) * r / den).otherwise(F.lit(0.0))


def curve_frame(curve: DataFrame) -> DataFrame:
    """The curve with f1, for charts and export."""
    return curve.withColumn("f1", fbeta(F.col("precision"), F.col("recall"))).drop("dp")


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision; undefined without positives. A recall step is dp/n_pos."""
    return curve.groupBy(*keys).agg(
        F.max("n_pos").alias("n_positive"), F.max(F.col("n_pos") + F.col("n_neg")).alias("n_windows"),
        F.try_divide(F.sum(F.col("dp") * F.col("precision")), F.max("n_pos").cast("double")).alias("ap"))


#: Kind of rule: (what must reach the rule's value, what is made greatest), as columns of curve points.
MERITS = {"fbeta": (None, lambda value: fbeta(F.col("precision"), F.col("recall"), value)),
          "precision": ("precision", lambda value: F.col("recall")),
          "recall": ("recall", lambda value: F.col("precision"))}


def rule_name(rule: Rule) -> str:
    """First letter and value, as in p0.95."""
    return f"{rule.kind[:1]}{rule.value:g}"


def rule_column(rule: Rule) -> str:
    return rule_name(rule).replace(".", "_")


def _merit(rule: Rule) -> tuple[Column, Column]:
    """(eligible, what is maximised) of one rule over curve points."""
    if rule.kind not in MERITS:
        raise ValueError(f"no such kind of rule: {rule.kind}; there are {', '.join(MERITS)}")
    floored, goal = MERITS[rule.kind]
    ok = (F.col("tp") + F.col("fp") >= rule.min_support) & (F.col("n_pos") > 0)
    return (ok & (F.col(floored) >= rule.value) if floored else ok), goal(rule.value)


def apply_rules(curve: DataFrame, keys: list[str], rules=DEFAULT_RULES) -> DataFrame:
    """One struct column per rule (named by its column suffix), all in one aggregation.

    Ties go to the highest theta. An infeasible rule keeps NULLs and says why.
    """
    point = F.struct("theta", "precision", "recall", "tp", "fp", "fn")
    aggs = [F.max("n_pos").alias("_n_pos")]
    for i, rule in enumerate(rules):
        ok, merit = _merit(rule)
        supported = F.col("tp") + F.col("fp") >= rule.min_support
        best_of = "recall" if rule.kind == "recall" else "precision"
        aggs += [F.max_by(point, F.when(ok, F.struct(merit.alias("m"), F.col("theta").alias("t")))).alias(f"_b{i}"),
                 F.max(F.when(supported, F.col(best_of))).alias(f"_best{i}")]
    picked = curve.groupBy(*keys).agg(*aggs)
    cols = []
    for i, rule in enumerate(rules):
        b, found = F.col(f"_b{i}"), F.col(f"_b{i}.theta").isNotNull()
        if rule.kind == "fbeta":
            miss = F.lit(f"no point predicts ≥ {rule.min_support} windows")
        else:
            miss = F.concat(F.lit(f"{rule.kind} never reaches {rule.value:g} (best "),
                            F.coalesce(F.format_string("%.3f", F.col(f"_best{i}")), F.lit("nan")), F.lit(")"))
        reason = F.when(found, F.lit("")).when(
            F.col("_n_pos") == 0, F.lit("no positives in the evaluation set")).otherwise(miss)
        cols.append(F.struct(
            b["theta"].alias("theta"), b["precision"].alias("precision"), b["recall"].alias("recall"),
            F.when(found, fbeta(b["precision"], b["recall"])).alias("f1"),
            F.coalesce(b["tp"], F.lit(0)).alias("tp"), F.coalesce(b["fp"], F.lit(0)).alias("fp"),
            F.coalesce(b["fn"], F.col("_n_pos")).alias("fn"),
            found.alias("feasible"), reason.alias("reason")).alias(rule_column(rule)))
    return picked.select(*keys, F.col("_n_pos").alias("n_pos"), *cols)


def floor_thetas(curve: DataFrame, keys: list[str], floors, min_support: int = 10) -> DataFrame:
    """(keys, n_pos, thetas): the theta of many precision floors in one slim aggregation, as an array of (floor, theta).

    Recall grows with tp, so the deepest point that holds the floor is the largest (tp, theta).
    """
    ok = (F.col("tp") + F.col("fp") >= min_support) & (F.col("n_pos") > 0)
    deepest = F.struct("tp", "theta")
    return curve.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"),
        F.array(*[F.struct(F.lit(float(p)).alias("floor"),
                           F.max(F.when(ok & (F.col("precision") >= p), deepest))["theta"].alias("theta")) for p in floors]).alias("thetas"))


def rule_rows(curve: DataFrame, keys: list[str], rules=DEFAULT_RULES) -> DataFrame:
    """The same, long: one row per (keys, rule)."""
    wide = apply_rules(curve, keys, rules)
    arr = F.array(*[F.struct(F.lit(rule_name(r)).alias("rule"), *[F.col(f"{rule_column(r)}.{c}").alias(c) for c in (
        "theta", "precision", "recall", "f1", "tp", "fp", "fn", "feasible", "reason")]) for r in rules])
    return wide.select(*keys, F.explode(arr).alias("r")).select(*keys, "r.*")


def per_species_table(curve: DataFrame, keys: list[str], rules=DEFAULT_RULES) -> DataFrame:
    ap = average_precision(curve, keys)
    picked = apply_rules(curve, keys, rules).drop("n_pos")
    out = ap.join(picked, keys).withColumn("prevalence", F.col("n_positive") / F.col("n_windows"))
    return out.select(
        *keys, "n_positive", "n_windows", "prevalence", "ap",
        *[F.col(f"{rule_column(r)}.{c}").alias(f"{c}_{rule_column(r)}") for r in rules
          for c in ("theta", "precision", "recall", "feasible")])


def cmap(per_species: DataFrame, keys: list[str], min_positives: int = 1) -> DataFrame:
    """Unweighted mean AP over species with enough positives; exclusions are counted, not hidden."""
    kept = (F.col("n_positive") >= min_positives) & F.col("ap").isNotNull()
    return per_species.groupBy(*keys).agg(
        F.avg(F.when(kept, F.col("ap"))).alias("cmap"), F.count_if(kept).alias("n_species"),
        F.count_if(~kept).alias("n_excluded"), F.lit(min_positives).cast("long").alias("min_positives"))


def summary(aligned: DataFrame, arm: list[str], rules=DEFAULT_RULES, min_positives: int = 1) -> DataFrame:
    """One league row per arm: cmAP, micro AP and each rule's global theta.

    The pooled curve starts from the per-species tie counts, so the frame is scanned once.
    """
    keys = [*arm, "species_key"]
    ties = cut(tie_counts(aligned, keys))
    table = per_species_table(curve_from_ties(ties, keys), keys, rules=())
    pooled = ties.groupBy(*arm, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    micro = curve_from_ties(pooled, arm)
    micro_ap = average_precision(micro, arm).select(
        *arm, F.col("ap").alias("micro_ap"), F.col("n_windows").alias("n_pairs"))
    picks = apply_rules(micro, arm, rules)
    picks = picks.select(*arm, *[F.col(f"{rule_column(r)}.{c}").alias(f"{c}_{rule_column(r)}") for r in rules
                                 for c in ("theta", "precision", "recall")])
    windows = aligned.groupBy(*arm, "recording_id", "start_s").agg(F.lit(1)).groupBy(*arm).agg(
        F.count(F.lit(1)).alias("n_windows"))
    return cmap(table, arm, min_positives).join(micro_ap, arm).join(windows, arm).join(picks, arm)


def point_at(curve: DataFrame, keys: list[str], theta: Column) -> DataFrame:
    """Precision and recall at any theta: the last point still at or above it."""
    at = F.when(F.col("theta") >= theta, F.col("theta"))
    best = curve.groupBy(*keys).agg(
        F.min_by(F.struct("precision", "recall", "tp", "fp"), at).alias("b"), F.max("n_pos").alias("n_pos"))
    return best.select(*keys, F.col("b.precision").alias("precision"),
                       F.coalesce(F.col("b.recall"), F.lit(0.0)).alias("recall"),
                       F.coalesce(F.col("b.tp"), F.lit(0)).alias("tp"), F.coalesce(F.col("b.fp"), F.lit(0)).alias("fp"))


def rank_resolution(aligned: DataFrame, keys: list[str], min_positives: int = 10) -> DataFrame:
    """Share of distinct scores among each species' top min(n, max(2*positives, 100)) windows.

    Works on tie counts: a tied group contributes one distinct score while its first row is in the top.
    """
    cum = running_totals(tie_counts(aligned, keys), keys, "score", {"seen": "n", "tp": "p"})
    k = F.least(F.col("total_seen"), F.greatest(2 * F.col("total_tp"), F.lit(100)))
    return cum.where(F.col("total_tp") >= min_positives).groupBy(*keys).agg(
        F.max("total_tp").alias("n_positive"), F.max(k).alias("top_k"),
        (F.count_if(F.col("seen") - F.col("n") < k) / F.max(k)).alias("distinct_fraction"))


def rank_resolution_summary(per_species: DataFrame, arm: list[str]) -> DataFrame:
    """The arm's median; one row per species reaches this, so ``median`` stays small."""
    return per_species.groupBy(*arm).agg(
        F.median("distinct_fraction").alias("median_distinct_fraction"), F.count(F.lit(1)).alias("n_species"),
        (F.median("distinct_fraction") < RANK_RESOLUTION_FLOOR).alias("damaged"))
