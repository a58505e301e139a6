"""What many folds have in common is worked out once, and gives what each of them would get alone."""

import numpy as np
import pandas as pd
import pytest

from chorale.operators import heldout as ho
from chorale.operators.survey import Cells
from chorale.params import FIRM_FLOORS, FLOORS, KS, Constraints
from test_heldout import ALIGNED, plain_thetas


@pytest.mark.parametrize("close", [512, 0])
def test_folds_whose_rows_lie_alike_are_refitted_once(spark, monkeypatch, close):
    monkeypatch.setattr(ho, "CLOSE", close)
    rng = np.random.default_rng(3)
    rows = [("m", f"r{f}", "s", int(s > .4), round(float(s), 2)) for f in range(40) for s in np.append(rng.random(2) * .2, rng.choice([.3, .5, .9], 4))]
    al = spark.createDataFrame(rows, ALIGNED)
    folds = spark.createDataFrame([(f"r{f}", f) for f in range(41)], "recording_id string, fold int")  # one without rows
    built, cut = [], ho.cut
    monkeypatch.setattr(ho, "cut", lambda df: (built.append(cut(df)), built[-1])[1])
    got = {r.fold: (r.n_pos, [t and float(np.float32(t)) for t in r.thetas]) for r in ho.held_out_thetas(
        ho.fold_ties(al, ["m", "species_key"], folds), ["m", "species_key"], folds.select("fold"), 41, (.5, .9, .99), 10).collect()}
    refitted = [df.select("fold").distinct().count() for df in built if {"fold", "like"} <= set(df.columns) and "own" not in df.columns or {"fold", "bin", "score"} <= set(df.columns)]
    assert refitted and max(refitted) < 40
    frame = pd.DataFrame(rows, columns=["m", "recording_id", "species_key", "y_true", "score"])
    frame["score"] = frame["score"].astype(np.float32)
    assert got == {f: plain_thetas(frame[frame.recording_id != f"r{f}"], (.5, .9, .99), 10) for f in range(41)}


def _choice(n_pairs, cons):
    cells, rng = Cells(FIRM_FLOORS, KS, FLOORS, 2), np.random.default_rng(4)
    fa = np.sort(rng.integers(0, 40, (n_pairs, len(cells.bars))), axis=1)[:, ::-1]
    fs, cls = np.maximum(fa - rng.integers(0, 3, fa.shape), 0), rng.choice(list("aaaw"), n_pairs)
    tables = pd.DataFrame([("m", "s", 1, cells.counts(cls, fs, fa, fs, fa).astype(np.int32).tobytes())], columns=["run", "species_key", "vec", "cells"])
    rows = [("m", f"f{i}", "s", 1, cls[i], fs[i], fa[i], fs[i], fa[i], n_pairs - 1, 72.0 * (n_pairs - 1)) for i in range(50)]
    folds = pd.DataFrame(rows, columns=["run", "fold", "species_key", "vec", "cls", "fs", "fa", "cs", "ca", "n", "hours"])
    return cells, (cls, fs, fa), ho.choose(folds, tables, cells, cons, 1, "run")


def test_folds_are_looked_at_only_in_cells_that_can_be_chosen(monkeypatch):
    seen, own_cells = [], ho._own_cells
    monkeypatch.setattr(ho, "_own_cells", lambda *a: (seen.append(len(a[4])), own_cells(*a))[1])
    cons = Constraints(min_firm_precision=.6, objective="firm_recall")
    cells, (cls, fs, fa), got = _choice(3000, cons)
    assert seen and max(seen) < len(cells.valid()) / 4
    valid = np.array(cells.valid())
    monkeypatch.setattr(ho, "_may_be_chosen", lambda bounds, *a: np.ones(len(valid), bool))
    assert got.equals(_choice(3000, cons)[2])
    left = np.arange(len(cls)) != 7  # one fold the long way
    t = cells.counts(cls[left], fs[left], fa[left], fs[left], fa[left])[:, valid[:, 0], valid[:, 1], valid[:, 2]]
    recall = np.where(t[0] / np.maximum(t[0] + t[1], 1) >= .6, t[0] / (t[0] + t[3] + t[6] + t[7]), -1)
    assert got[(got["fold"] == "f7") & got["run"].notna()]["firm_recall"].tolist() == [recall.max()]


def test_a_choice_that_finds_nothing_keeps_the_kinds_of_its_columns():
    got = _choice(60, Constraints(min_firm_precision=1.1))[2]
    assert len(got) == 0 and got["run"].dtype == object and got["fold"].dtype == object
