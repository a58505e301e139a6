import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import survey as sv
from chorale.operators import resample as rs
from chorale.operators.curves import tie_counts
from chorale.params import Condition, Constraints, RuleSpec, SurveyRule

DET = "m string, recording_id string, start_s double, species_key string, score_raw float, implausible boolean"


def det(spark):
    rows = []
    add = lambda r, sp, n, imp=False, s=.9: rows.extend(("m", r, 3.0 * i, sp, s, imp) for i in range(n))
    add("r1", "Turdus migratorius", 5)
    add("r1", "Troglodytes aedon", 1)
    add("r1", "Cyanocitta stelleri", 3)
    add("r1", "Strix varia", 1)
    add("r1", "Car", 9)
    add("r2", "Turdus migratorius", 3, True)
    return spark.createDataFrame(rows, DET)


def setup(spark):
    bars = spark.createDataFrame([("m", None, "p0.95", 0.5)], "m string, species_key string, bar string, theta double")
    ev = sv.evidence(sv.species_only(det(spark), ["m"]), bars, ["m"], (10.0,))
    truth = spark.createDataFrame([("m", "r1", "Turdus migratorius"), ("m", "r1", "Troglodytes aedon"), ("m", "r2", "Turdus migratorius"), ("m", "r2", "Poecile gambeli"), ("m", "r1", "Poecile gambeli")],
                                  "m string, recording_id string, species_key string")
    labels = spark.createDataFrame([(x,) for x in ("Turdus migratorius", "Troglodytes aedon", "Cyanocitta stelleri", "Poecile gambeli")], "species_key string")
    recs = spark.createDataFrame([("m", "r1", 1.0), ("m", "r2", 1.0)], "m string, recording_id string, hours double")
    return ev, truth, labels, recs


def test_three_tiers(spark):
    ev, truth, labels, recs = setup(spark)
    rule = SurveyRule(Condition(.95, 1), Condition(.95, 3))
    out = sv.outcomes(sv.tiers(ev, rule, ["m"]), truth, ["m"], labels)
    got = {(r.recording_id, r.species_key): r.outcome for r in out.collect()}
    assert got == {("r1", "Turdus migratorius"): "firm, right", ("r1", "Troglodytes aedon"): "check, real", ("r1", "Cyanocitta stelleri"): "firm, wrong",
                   ("r1", "Strix varia"): "check, can't judge", ("r1", "Poecile gambeli"): "missed", ("r2", "Turdus migratorius"): "filter hid a real bird",
                   ("r2", "Poecile gambeli"): "missed"}
    s = sv.score(sv.per_recording(out, recs, ["m"]), ["m"]).first()
    assert (s.firm_precision, s.recall_reviewed, s.firm_recall) == pytest.approx((1 / 2, 2 / 5, 1 / 5))


def test_span_count(spark):
    ev, *_ = setup(spark)
    assert ev.where("recording_id = 'r1' and species_key = 'Turdus migratorius'").first().w10_all == 4


def test_sweep_cells_equal_direct_assessment(spark):
    ev, truth, labels, recs = setup(spark)
    ev = ev.unionByName(ev.withColumn("bar", F.lit("p0.5")).withColumn("n_all", F.col("n_all") + 1).withColumn("n_shown", F.col("n_shown") + 1))
    rule, floors, ks = SurveyRule(Condition(.95, 2), Condition(.95, 3)), (.5, .95), (1, 2, 3, 5)
    cells = sv.sweep(ev, rule, truth, recs, ["m"], labels, floors, ks, floors).collect()
    assert len(cells) == 12
    for c in cells:
        r = sv.cell_rule(rule, c.floor, c.k, c.check_floor)
        s = sv.score(sv.assess(ev, r, truth, recs, ["m"], labels), ["m"]).first()
        assert [c[x] for x in sv.STATS] == pytest.approx([s[x] for x in sv.STATS], nan_ok=True)


def test_best_prefers_objective_then_fewer_checks(spark):
    cols = "m string, check_floor double, floor double, k int, " + ", ".join(f"{s} double" for s in sv.STATS)
    row = lambda f, k, fp, rr, ch: ("m", f, f, k, fp, rr, .1, ch, .1, .1, .1)
    sw = spark.createDataFrame([row(.5, 1, .5, .9, 1.), row(.9, 2, .96, .8, 3.), row(.9, 3, .97, .8, 2.)], cols)
    b = sv.best(sw, Constraints(), ["m"]).first()
    assert (b.floor, b.k) == (.9, 3)
    assert sv.best(sw, Constraints(min_firm_precision=.99), ["m"]).count() == 0
    assert sv.relaxed(sw, Constraints(min_firm_precision=.99), ["m"]).first().relaxed == "checks, recall, precision"


def test_few_labels_take_the_fallback(spark):
    rows = [("m", "a", float(np.float32(.9 - i / 100)), 1 if i < 20 else 0, 1) for i in range(40)] + [("m", "b", float(np.float32(.5)), 1, 1)]
    ties = spark.createDataFrame(rows, "m string, species_key string, score float, p long, n long")
    b = {(r.species_key, r.bar): r.theta for r in sv.fit_bars(ties, ["m"], RuleSpec(), (.95,)).collect()}
    assert b[("b", "p0.95")] == b[(None, "p0.95")] and b[("a", "p0.95")] is not None


def test_split_is_reproducible_and_sized(spark):
    r = spark.createDataFrame([(f"r{i}",) for i in range(31)], "recording_id string")
    a = {x.recording_id: x.side for x in sv.split(r, 4, .5).collect()}
    b = {x.recording_id: x.side for x in sv.split(r.repartition(7), 4, .5).collect()}
    assert a == b and sum(s == "test" for s in a.values()) == 16


def test_bootstrap_with_numpy_draws_equals_numpy(spark):
    rng = np.random.default_rng(0)
    r, n = 8, 60
    mat = rng.integers(1, 50, (r, len(rs.COUNTS))).astype(float)
    per = spark.createDataFrame([("m", f"r{i}", i, *map(float, mat[i])) for i in range(r)], "m string, recording_id string, idx int, " + ", ".join(f"`{c}` double" for c in rs.COUNTS))
    idx = np.random.default_rng(7).integers(0, r, size=(n, r))
    draws = spark.createDataFrame([(k, int(i), int(w)) for k in range(n) for i, w in zip(*np.unique(idx[k], return_counts=True))], "rep int, idx int, w int")
    got = {x.stat: (x.lo, x.hi) for x in rs.bootstrap(per, ["m"], n, draws=draws).collect()}
    sums = mat[idx].sum(axis=1)
    at = {c: i for i, c in enumerate(rs.COUNTS)}
    for s, (a, b) in rs.STATS.items():
        v = sums[:, at[a]] / sums[:, at[b]]
        assert got[s] == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])))


def test_no_interval_below_five_recordings(spark):
    per = spark.createDataFrame([("m", f"r{i}", *[1.0] * 7) for i in range(4)], "m string, recording_id string, " + ", ".join(f"`{c}` double" for c in rs.COUNTS))
    assert all(x.lo is None for x in rs.bootstrap(per, ["m"], 20).collect())
