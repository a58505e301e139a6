"""Steps that have to keep their shape on large tables, and rows that only larger tables hold."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chorale.operators import heldout as ho
from chorale.operators.intervals import interval_join
from chorale.operators.survey import Cells
from chorale.params import Constraints
from chorale.plans import q_outcomes as qo
from chorale.plans import q_survey as qs
from chorale.plans import testbed as tb
from chorale.plans.registry import QUERIES, with_ctes
from chorale.session import spread


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_windows_of_an_interval_join_are_never_sent_whole(spark):
    wins = spark.createDataFrame([("a", 0.0, 9.0)], "recording_id string, t0 double, t1 double").select(
        "recording_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select(
        "recording_id", F.col("i").cast("double").alias("start_s"), (F.col("i") + 1).cast("double").alias("end_s"))
    boxes = spark.createDataFrame([("a", 2.5, 3.5)], "recording_id string, start_s double, end_s double")
    both = interval_join(wins, boxes, ["recording_id"], 4.0)
    assert sorted(r.start_s for r in both.collect()) == [2.0, 3.0]
    assert "BroadcastHashJoin" not in _plan(both)


def test_windows_are_made_by_many_tasks(spark, tmp_path):
    d = _events(spark, tmp_path, [(i, "2024-01-02 00:00:00", i * 5, "click", 1.0, '{"k": 60}') for i in range(64)])
    wins = tb.score_windows(spark, d).select("recording_id")
    assert wins.where(F.col("recording_id").isNotNull()).groupBy().count().first()[0] == 64 * 200
    assert "REPARTITION_BY_NUM" in _plan(tb.score_windows(spark, d))


def test_groups_of_large_tables_are_not_held_by_the_task_that_reads_them(spark, tmp_path, monkeypatch):
    d = _events(spark, tmp_path, [(i, "2024-01-02 00:00:00", i * 5, "click", 1.0, '{"k": 60}') for i in range(64)])
    built, cut = [], tb.cut
    monkeypatch.setattr(tb, "cut", lambda df: (built.append(df), cut(df))[1])
    monkeypatch.setattr(tb, "_STORED", {})
    assert tb.scored(spark, d).count() == 128
    scores = _plan(built[-1])
    assert qs.ev(spark, d).where("n_all > 0").count() > 0
    for plan, sums in ((scores, "partial_max"), (_plan(built[-1]), "partial_count")):
        assert plan.rindex(sums) < plan.index("REPARTITION_BY_NUM")  # parents come first


def test_tasks_grow_in_number_with_known_rows(spark):
    few, many = (spread(spark.range(4), "id", rows=n).rdd.getNumPartitions() for n in (4, 90_000_000))
    assert few < 100 and many == 360


def test_a_window_that_scores_nothing_is_not_hidden(spark, tmp_path):
    rows = [(1000, "2024-01-02 00:00:00", 0, "click", 1.0, '{"k": 10}'), (2002, "2024-01-03 00:00:00", 0, "click", 1.0, '{"k": 10}')]
    d = _events(spark, tmp_path, rows)
    key = "Catharus guttatus"
    got = {tuple(r) for r in QUERIES["K1_label_windows"].run(spark, d).where(F.col("species_key") == key).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(with_ctes(QUERIES["K1_label_windows"].sql)).fetchall() if r[3] == key}
    assert got == want
    assert sum(r[-1] for r in got) == 2  # the second event, in both runs
    assert qo.lab(spark, d).where("hidden and score <= 0").count() == 0


def test_cells_of_many_recordings_are_added_up_before_the_choice():
    cells = Cells((0.9,), (1,), (0.5,), 1)
    table = np.zeros((8, 1, 1, 1), np.int32)
    table[0], table[7] = 50000, 10000  # more than a part of the pairs can hold
    tables = pd.DataFrame([("m", "s", 1, table.tobytes())], columns=["run", "species_key", "vec", "cells"])
    rows = [("m", f, "s", 1, "a" if f == 0 else None, *[[1, 1] if f == 0 else None] * 4, 60000, 60000.0) for f in range(3)]
    folds = pd.DataFrame(rows, columns=["run", "fold", "species_key", "vec", "cls", "fs", "fa", "cs", "ca", "n", "hours"])
    got = ho.choose(folds, tables, cells, Constraints(min_firm_precision=0.5), 1, "run")
    own = got[got["run"].notna()].set_index("fold")["recall_reviewed"].to_dict()
    assert own == {0: 49999 / 59999, 1: 50000 / 60000, 2: 50000 / 60000}


def test_replicates_are_drawn_by_many_tasks_in_slices(spark, monkeypatch):
    from chorale.operators import resample as rs
    rows = [(m, f"r{i}", float(i % 7 + (m == "b"))) for i in range(900) for m in "ab"]
    per = spark.createDataFrame(rows, "run_id string, recording_id string, right double").coalesce(1)
    sums = rs.replicate_sums(per, ["run_id"], ["right"], 20, 3)
    assert "REPARTITION_BY_NUM" in _plan(sums)  # few rows of much work each: put together, one task would draw them all
    got = {(r.run_id, r.rep): (r.right, r.units) for r in sums.collect()}
    import hashlib
    u = lambda rep, unit: int(hashlib.md5(f"3:{rep}:{unit}".encode()).hexdigest()[:13], 16) / 4503599627370496.0
    for m in "ab":
        for rep in range(20):
            w = [sum(u(rep, f"r{i}") > c for c in rs.POISSON_1) for i in range(900)]
            assert got[m, rep] == (sum(x * (i % 7 + (m == "b")) for i, x in enumerate(w)), sum(w))
    most = []
    stack = np.stack
    monkeypatch.setattr(np, "stack", lambda a, *k, **o: most.append(len(a)) or stack(a, *k, **o))
    monkeypatch.setattr(rs, "spread", lambda df, *k: df)

    class Plain:
        """Runs a task's function here, on one batch of all rows."""
        def __init__(self, df): self.df = df
        def sortWithinPartitions(self, *k): return self
        def mapInPandas(self, fn, shape):
            list(fn([self.df.toPandas()]))
            return self.df.limit(0).selectExpr("run_id", "0 AS rep", "right", "0L AS units")
    monkeypatch.setattr(rs, "spread", lambda df, *k: Plain(df))
    rs.replicate_sums(per, ["run_id"], ["right"], 20, 3)
    assert max(most) <= rs.DRAWN < 1800


def test_hidden_rows_meet_windows_before_they_become_a_row_per_species(spark):
    from chorale.operators.align import align_windows, dense_scores, labelled_windows, with_species
    from chorale.operators.outcomes import label_windows
    wins = spark.createDataFrame([("A", "r", float(i), i + 1.0, [0.9, 0.2 * i]) for i in range(4)], "run_id string, recording_id string, start_s double, end_s double, scores array<double>")
    boxes = spark.createDataFrame([("r", 0.0, 1.0, "x"), ("r", 1.5, 3.0, "y")], "recording_id string, start_s double, end_s double, species_key string")
    hidden = spark.createDataFrame([("A", "r", 0.0, "x"), ("A", "r", 0.0, "x"), ("A", "r", 2.0, "y"), ("A", "r", 2.0, "z"), ("A", "gone", 0.0, "x")], "run_id string, recording_id string, start_s double, species_key string")
    thetas = spark.createDataFrame([("x", 0.5), ("y", None)], "species_key string, theta double")
    sp = ["x", "y"]
    plain = label_windows(align_windows(wins, sp, sp, boxes, 4.0), thetas, ["species_key"], hidden, ["run_id"])
    got = label_windows(dense_scores(with_species(labelled_windows(wins, boxes, 4.0), hidden, "hidden"), sp, sp, "labels", "hidden"), thetas, ["species_key"])
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and got.where("hidden").count() == 2


def test_a_table_as_small_as_the_label_space_is_sent_to_the_dense_frame(spark, tmp_path):
    d = _events(spark, tmp_path, [(i, "2024-01-02 00:00:00", i * 5, "click", 1.0, '{"k": 60}') for i in range(64)])
    assert "Exchange" not in _plan(tb.species(spark, d))  # names are a table, whose size the planner knows, not a distinct of all events
    plan = _plan(tb.aligned(spark, d).join(tb.species(spark, d).select("species_key", "theta"), "species_key", "left"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert qo.lab(spark, d).where("hidden").count() == 128 and qo.lab(spark, d).count() == 64 * 200 * 10


def test_pairs_that_no_cell_tells_apart_are_counted_together(spark):
    from chorale.operators.survey import alike_pairs
    cells = Cells((0.5, 0.9), (1, 3), (0.5,), 2)
    rng = np.random.default_rng(1)
    rows = [("m", str(rng.choice(list("awu"))), *[[int(x) for x in rng.integers(0, 9, 2)] for _ in range(4)]) for _ in range(3000)]
    pairs = spark.createDataFrame(rows, "run_id string, cls string, fs array<int>, fa array<int>, cs array<int>, ca array<int>")
    got = alike_pairs(pairs, ["run_id"], cells).toPandas()
    assert got["times"].sum() == 3000 and len(got) < 3000 and max(map(max, got["fs"])) == 3 and max(map(max, got["ca"])) == 2
    table = lambda col: np.array([list(x) for x in col])
    plain = cells.counts(np.array([r[1] for r in rows]), *[table([r[i] for r in rows]) for i in range(2, 6)])
    assert (cells.counts(got["cls"].to_numpy(), *[table(got[c]) for c in ("fs", "fa", "cs", "ca")], got["times"]) == plain).all()
