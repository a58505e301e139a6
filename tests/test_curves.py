import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import curves as cv
from chorale.operators import prefix
from chorale.params import Rule


def frame(spark, ys, ss, sp="a"):
    return spark.createDataFrame([("r", float(i), float(i + 1), sp, int(y), float(s)) for i, (y, s) in enumerate(zip(ys, ss))],
                                 "recording_id string, start_s double, end_s double, species_key string, y_true int, score float")


def points(df):
    return sorted(df.collect(), key=lambda r: -r.theta)


def test_hand_curve(spark):
    c = points(cv.pr_curve(frame(spark, [1, 0, 1, 1, 0, 0], [.9, .8, .7, .6, .5, .4]), ["species_key"]))
    assert [r.tp for r in c] == [1, 1, 2, 3, 3, 3]
    assert [r.fp for r in c] == [0, 1, 1, 1, 2, 3]
    assert [r.precision for r in c] == pytest.approx([1, .5, 2 / 3, .75, .6, .5])


def test_ties_share_one_point(spark):
    c = points(cv.pr_curve(frame(spark, [1, 0, 1], [.9, .9, .5]), ["species_key"]))
    assert [r.precision for r in c] == pytest.approx([.5, 2 / 3])


def test_average_precision(spark):
    c = cv.pr_curve(frame(spark, [1, 0, 1, 1, 0, 0], [.9, .8, .7, .6, .5, .4]), ["species_key"])
    assert cv.average_precision(c, ["species_key"]).first().ap == pytest.approx(1 / 3 + 2 / 9 + .25)


def test_no_positives_is_undefined(spark):
    c = cv.pr_curve(frame(spark, [0, 0, 0], [.3, .2, .1]), ["species_key"])
    assert cv.average_precision(c, ["species_key"]).first().ap is None
    assert cv.rule_rows(c, ["species_key"], (Rule("fbeta", 1.0, 1),)).first().reason == "no positives in the evaluation set"


def test_average_precision_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(6):
        y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1 + k % 3).astype(np.float32)
        rows += [(f"s{k}", int(a), float(b)) for a, b in zip(y, s)]
        ap, tp = 0.0, 0
        for t in sorted(set(s.tolist()), reverse=True):
            hit = s >= np.float32(t)
            new = int(y[hit].sum())
            ap += (new - tp) / y.sum() * new / hit.sum()
            tp = new
        want[f"s{k}"] = ap
    df = spark.createDataFrame(rows, "species_key string, y_true int, score float")
    got = {r.species_key: r.ap for r in cv.average_precision(cv.pr_curve(df, ["species_key"]), ["species_key"]).collect()}
    assert got == pytest.approx(want)


def test_rule_ties_take_highest_theta(spark):
    c = cv.pr_curve(frame(spark, [1, 1, 0, 0], [.9, .8, .7, .6]), ["species_key"])
    r = cv.rule_rows(c, ["species_key"], (Rule("recall", 0.5, 1), Rule("precision", 0.5, 1))).collect()
    by = {x.rule: x for x in r}
    assert by["r0.5"].theta == pytest.approx(0.9)
    assert by["p0.5"].theta == pytest.approx(0.8) and by["p0.5"].recall == 1.0


def test_min_support_makes_infeasible(spark):
    r = cv.rule_rows(cv.pr_curve(frame(spark, [1, 0], [.9, .8]), ["species_key"]), ["species_key"], (Rule("precision", .95, 10),)).first()
    assert not r.feasible and r.theta is None and r.reason.startswith("precision never reaches 0.95")


def test_point_at_between_points(spark):
    c = cv.pr_curve(frame(spark, [1, 0, 1], [.9, .6, .3]), ["species_key"])
    p = cv.point_at(c, ["species_key"], F.lit(0.5)).first()
    assert (p.tp, p.fp) == (1, 1)
    assert cv.point_at(c, ["species_key"], F.lit(0.95)).first().recall == 0.0


def test_floor_thetas_equal_rules(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.integers(0, 2, 300), rng.random(300).round(2))
    c = cv.pr_curve(df, ["species_key"])
    floors = (.3, .5, .6, .9)
    slim = {e["floor"]: e["theta"] for e in cv.floor_thetas(c, ["species_key"], floors, 10).first().thetas}
    full = {float(r.rule[1:]): r.theta for r in cv.rule_rows(c, ["species_key"], [Rule("precision", f) for f in floors]).collect()}
    assert slim == full


def test_running_totals_match_one_window_under_saturation(spark):
    """A third of the rows share one score; bins must still give the exact cumulative counts."""
    rng = np.random.default_rng(5)
    s = np.concatenate([np.ones(500), rng.random(500), 1 - rng.random(500) * 1e-6, np.zeros(200)]).astype(np.float32)
    df = spark.createDataFrame([("k", float(x)) for x in s], "k string, v float")
    pos = {r.v: (r.n, r.upto) for r in prefix.positions(df, ["k"], "v").collect()}
    for v in np.unique(s):
        assert pos[float(v)] == (int((s == v).sum()), int((s >= v).sum()))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(6)
    v = rng.random(501)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 2.0)], "k string, v double")
    got = {r.k: r for r in prefix.exact_quantiles(df, ["k"], "v", {"q1": .25, "q9": .9}).collect()}
    assert (got["a"].q1, got["a"].q9) == pytest.approx(tuple(np.percentile(v, [25, 90])))
    assert got["b"].q1 == 2.0


def test_kth_largest_clamps(spark):
    df = spark.createDataFrame([("a", x) for x in (.1, .5, .5, .9)], "k string, v float")
    th = lambda k: prefix.kth_largest(df, ["k"], "v", F.lit(k)).first().theta
    assert th(1) == pytest.approx(.9) and th(3) == pytest.approx(.5) and th(99) == pytest.approx(.1)
