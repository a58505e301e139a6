"""Leave-one-out by subtraction against refitting, one fold after the other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chorale.operators import heldout as ho
from chorale.operators import survey as sv
from chorale.operators.curves import tie_counts
from chorale.params import Condition, Constraints, RuleSpec, SurveyRule

ALIGNED = "m string, recording_id string, species_key string, y_true int, score float"
FLOORS = (.1, .5, .7, .85, .9, .99)


def plain_thetas(rows: pd.DataFrame, floors, least: int):
    """(positives, theta per floor) of one curve, by looking at every distinct score."""
    out, best = [], [None] * len(floors)
    for t in sorted(set(rows.score), reverse=True):
        at = rows[rows.score >= t]
        tp, n = int(at.y_true.sum()), len(at)
        if n >= least:
            for i, f in enumerate(floors):
                if rows.y_true.sum() and tp / n >= f and (best[i] is None or tp > best[i][0]):
                    best[i] = (tp, float(np.float32(t)))
    return int(rows.y_true.sum()), [b and b[1] for b in best]


@pytest.mark.parametrize("seed, least, buckets", [(1, 1, 1 << 14), (2, 4, 3), (3, 10, 1), (4, 25, 7)])
def test_thetas_equal_refits(spark, monkeypatch, seed, least, buckets):
    monkeypatch.setattr(ho, "BUCKET", buckets)
    monkeypatch.setattr(ho, "FOLD_BLOCK", 4)
    rng = np.random.default_rng(seed)
    n, grid = 260, int(rng.choice([7, 40, 1000]))
    score = np.round(rng.integers(0, grid + 1, n) / grid, 4).astype(np.float32)
    rows = pd.DataFrame({"m": "m", "recording_id": [f"r{i}" for i in rng.integers(0, 9, n)], "species_key": [f"s{i}" for i in rng.choice(4, n, p=[.6, .3, .08, .02])],
                         "y_true": (rng.random(n) < .15 + .8 * score ** 2).astype(int), "score": score})
    rows.loc[rows.recording_id == "r8", "species_key"] = "s0"  # a fold that most species do not have
    al = spark.createDataFrame([tuple(r) for r in rows.astype({"score": float}).itertuples(index=False)], ALIGNED)
    folds = spark.createDataFrame([(f"r{i}", i) for i in range(11)], "recording_id string, fold int")  # two recordings without rows
    got = {(r.species_key, r.fold): (r.n_pos, [t and float(np.float32(t)) for t in r.thetas]) for r in ho.held_out_thetas(
        ho.fold_ties(al, ["m", "species_key"], folds), ["m", "species_key"], folds.select("fold"), 11, FLOORS, least).collect()}
    want = {(sp, f): plain_thetas(part[part.recording_id != f"r{f}"], FLOORS, least) for sp, part in rows.groupby("species_key") for f in range(11)}
    assert got == want


def world(spark, seed, n=9, species=("Aa aa", "Bb bb", "Cc cc", "Dd dd")):
    rng = np.random.default_rng(seed)
    al, det = [], []
    for r in range(n):
        for sp in species[:3]:
            for w in range(14):
                y = int(rng.random() < .45)
                s = float(np.float32(np.clip(rng.normal(.35 + .35 * y, .2), 0, 1).round(2)))
                al.append(("m1", f"r{r}", sp, y, s))
                al.append(("m2", f"r{r}", sp, y, float(np.float32(round(1 - (1 - s) * .8, 2)))))
                det += [(m, f"r{r}", 3.0 * w, sp, s, bool(rng.random() < .1)) for m in ("m1", "m2")]
        det += [("m1", f"r{r}", 3.0, species[3], .9, False)]  # a species without a curve
    truth = [(f"r{r}", sp) for r in range(n) for sp in (*species[:2], "Ee ee") if rng.random() < .6]
    return (spark.createDataFrame(al, ALIGNED), spark.createDataFrame(det, "m string, recording_id string, start_s double, species_key string, score_raw float, implausible boolean"),
            spark.createDataFrame(truth, "recording_id string, species_key string"), spark.createDataFrame([(f"r{r}", 1.0 + r) for r in range(n + 1)], "recording_id string, hours double"))


@pytest.mark.parametrize("rule, per_fold", [(SurveyRule(Condition(.5, 2), Condition(.9, 3)), 1), (SurveyRule(Condition(.5, 1), Condition(.9, 2, 9.0)), 2)])
def test_picks_and_held_out_counts_equal_the_long_way(spark, monkeypatch, rule, per_fold):
    monkeypatch.setattr(ho, "RECORDING_BLOCK", 4)
    monkeypatch.setattr(ho, "CHOICE_BLOCK", 3)
    al, det, truth, recs = world(spark, 5)
    floors, ks, check = (.5, .7, .9), (1, 2, 3, 5), (.3, .5, .7, .9)
    cons, spec = Constraints(min_firm_precision=.5, max_checks_per_recording=2.5), RuleSpec(min_support=5, min_labelled=8)
    labels = truth.select("species_key").distinct()
    folds = recs.select("recording_id", F.floor(F.expr("cast(substring(recording_id, 2) as int)") / per_fold).cast("int").alias("fold"))
    got = ho.held_out(al, det, folds, rule, spec, truth, recs, cons, labels, ["m1", "m2"], "m", floors, ks, check)
    own = {(r.m, r.fold): (r.check_floor, r.floor, r.k) for r in got["own"].collect()}
    shared = {r.fold: (r.check_floor, r.floor, r.k) for r in got["shared"].collect()}
    held = {(r.m, r.recording_id): tuple(r[c] for c in sv.OUT) for r in got["held_own"].collect()}
    spans = tuple(s for s in (rule.firm.within_s, rule.check.within_s) if s)
    by_model = lambda df: df.withColumn("m", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    n_folds = 10 // per_fold
    want_own, want_shared, want_held = {}, {}, {}
    for f in range(0, n_folds, 3):
        rest, out = folds.where(f"fold <> {f}").select("recording_id"), folds.where(f"fold = {f}").select("recording_id")
        bars = sv.fit_bars(tie_counts(al.join(rest, "recording_id"), ["m", "species_key"]), ["m"], spec, sorted({*floors, *check}))
        ev = sv.evidence(det, bars, ["m"], spans).cache()
        sw = sv.sweep(ev, rule, by_model(truth.join(rest, "recording_id")), by_model(recs.join(rest, "recording_id")), ["m"], labels, floors, ks, check).cache()
        want_own |= {(r.m, f): (r.check_floor, r.floor, r.k) for r in sv.best(sw, cons, ["m"]).collect()}
        want_shared |= {f: (r.check_floor, r.floor, r.k) for r in sv.best_shared(sw, cons, [], "m", 2).collect()}
        for m in ("m1", "m2"):
            if (m, f) in want_own:
                c, fl, k = want_own[m, f]
                r = SurveyRule(Condition(c, min(rule.check.k, k), rule.check.within_s), Condition(fl, k, rule.firm.within_s))
                per = sv.assess(ev.where(F.col("m") == m), r, by_model(truth.join(out, "recording_id")).where(F.col("m") == m), by_model(recs.join(out, "recording_id")).where(F.col("m") == m), ["m"], labels)
                want_held |= {(x.m, x.recording_id): tuple(x[c] for c in sv.OUT) for x in per.where(f"recording_id in (select recording_id from values {', '.join(repr((y.recording_id,)).replace(',)', ')') for y in out.collect())} as t(recording_id))").collect()}
    asked = set(range(0, n_folds, 3))
    assert {k: v for k, v in own.items() if k[1] in asked} == want_own and want_own
    assert {k: v for k, v in shared.items() if k in asked} == want_shared
    assert {k: held[k] for k in want_held} == want_held and want_held


def test_no_feasible_cell_lists_nothing_and_every_recording_is_there(spark):
    al, det, truth, recs = world(spark, 6, n=4)
    folds = recs.select("recording_id", F.col("recording_id").alias("fold"))
    got = ho.held_out(al, det, folds, SurveyRule(Condition(.5, 1), Condition(.9, 2)), RuleSpec(), truth, recs, Constraints(min_firm_precision=1.1), truth.select("species_key").distinct(), ["m1", "m2"], "m")
    assert got["own"].count() == 0 and got["shared"].count() == 0
    rows = got["held_own"].collect()
    assert len(rows) == 10 and sum(r.missed for r in rows) == 2 * truth.count() and sum(r.firm_right + r.check_real for r in rows) == 0
