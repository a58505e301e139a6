import numpy as np
from pyspark.sql import functions as F

from chorale.operators import intervals as iv


def spans(spark, rows):
    return spark.createDataFrame([(r, float(s), float(e)) for r, s, e in rows], "recording_id string, start_s double, end_s double")


def random_spans(n, seed, longest=40):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 500, n)
    return [("hot" if i % 3 else f"r{i % 4}", int(a), int(a + rng.integers(1, longest))) for i, a in enumerate(s)]


def test_bucketed_join_equals_plain_join(spark):
    a, b = random_spans(150, 1), random_spans(150, 2)
    left, right = spans(spark, a).withColumn("i", F.monotonically_increasing_id()), spans(spark, b).withColumn("j", F.monotonically_increasing_id())
    for rule in (iv.labels_window, iv.any_overlap, iv.flat_overlap, iv.either_overlap):
        got = iv.interval_join(left, right, ["recording_id"], 7.0, rule).select("start_s", "end_s", "b_start", "b_end", "recording_id")
        r2 = right.withColumnRenamed("start_s", "b_start").withColumnRenamed("end_s", "b_end")
        want = left.join(r2, "recording_id").where(rule(F.col("start_s"), F.col("end_s"), F.col("b_start"), F.col("b_end"))).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def brute_merge(rows, tol=1e-6):
    out = {}
    for r, s, e in sorted(rows):
        cur = out.setdefault(r, [])
        if cur and s <= cur[-1][1] + tol:
            cur[-1][1] = max(cur[-1][1], e)
        else:
            cur.append([s, e])
    return sorted((r, float(s), float(e)) for r, v in out.items() for s, e in v)


def test_merge_spans_across_blocks(spark):
    for block in (5.0, 50.0, 1e6):
        rows = random_spans(200, 3, 12)
        got = sorted(map(tuple, iv.merge_spans(spans(spark, rows), ["recording_id"], block).select("recording_id", "start_s", "end_s").collect()))
        assert got == brute_merge(rows)


def test_union_length(spark):
    rows = random_spans(120, 4, 15)
    got = {r.recording_id: r.covered_s for r in iv.union_length(spans(spark, rows), ["recording_id"], 9.0).collect()}
    want = {}
    for r, s, e in brute_merge(rows, 0):
        want[r] = want.get(r, 0) + e - s
    assert got == want


def test_span_counts_half_open(spark):
    d = spans(spark, [("r", t, t + 3) for t in (0, 3, 6, 9, 12)])
    assert iv.span_counts(d, ["recording_id"], 10.0).agg(F.max("in_span")).first()[0] == 4
    assert iv.span_counts(d, ["recording_id"], 3.0).agg(F.max("in_span")).first()[0] == 1


def test_within_is_the_backward_asof(spark):
    cov = spans(spark, [("r", 0, 60), ("r", 120, 180)])
    d = spans(spark, [("r", 0, 5), ("r", 57, 62), ("r", 120, 180), ("r", 100, 110), ("r", 179, 184)])
    got = sorted(r.start_s for r in iv.within(d, cov, 60.0).collect())
    assert got == [0.0, 120.0]
    dur = spark.createDataFrame([("r", 180.0)], "recording_id string, duration_s double")
    assert sorted(r.start_s for r in iv.within_or_last(d, cov, dur, 60.0).collect()) == [0.0, 120.0, 179.0]


def test_label_rule_extremes(spark):
    w = spans(spark, [("r", 0, 3), ("r", 3, 6)])
    def hit(s, e):
        return sorted(r.start_s for r in iv.interval_join(w, spans(spark, [("r", s, e)]), ["recording_id"], 3.0).collect())
    assert hit(2.9, 3.2) == []          # shorter than the floor and straddling: nobody's
    assert hit(1.0, 1.3) == [0.0]       # fully inside counts
    assert hit(2.5, 3.5) == [0.0, 3.0]  # exactly the floor counts
    assert hit(0.0, 6.0) == [0.0, 3.0]


def test_chunks_fold_the_tail(spark):
    r = spark.createDataFrame([("a", 120.5, "s", ""), ("b", 30.0, "s", "")], "recording_id string, duration_s double, site string, start_time string")
    got = sorted((x.recording_id, x.start_s, x.end_s) for x in iv.all_chunks(r).collect())
    assert got == [("a", 0.0, 60.0), ("a", 60.0, 120.5), ("b", 0.0, 30.0)]


def test_merge_runs_breaks_on_another_species(spark):
    b = spark.createDataFrame([("r", 0., 3., "a", .5), ("r", 3., 6., "a", .9), ("r", 6., 9., "b", .4), ("r", 9., 12., "a", .3), ("r", 20., 23., "a", .2)],
                              "recording_id string, start_s double, end_s double, species_key string, score_raw double")
    got = sorted(map(tuple, iv.merge_runs(b, ["recording_id"], 6.0).select("start_s", "end_s", "species_key", "score_raw").collect()))
    assert got == [(0., 6., "a", .9), (6., 9., "b", .4), (9., 12., "a", .3), (20., 23., "a", .2)]


def test_score_runs_split_at_gaps(spark):
    b = spark.createDataFrame([("r", float(t), float(t + 5), "a") for t in (0, 1, 2, 9, 10)], "recording_id string, start_s double, end_s double, species_key string")
    runs = iv.score_runs(b, ["recording_id"], F.lit(1.0), 3.0).groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [2, 3]


def test_pack_rows_first_fit(spark):
    b = spark.createDataFrame([("v", 0., 5., 0), ("v", 1., 3., 1), ("v", 3., 6., 2), ("v", 5., 7., 3)], "view string, start_s double, end_s double, tie long")
    got = {(r.start_s): r.row for r in iv.pack_rows(b, ["view"], "view string, start_s double, end_s double, tie long, row long").collect()}
    assert got == {0.: 0, 1.: 1, 3.: 1, 5.: 0}


def test_last_span_and_closed_time_against_a_scan(spark):
    import random

    from chorale.operators.align import closed_time_only
    r = random.Random(7)
    spans, rows, length = [], [], {f"r{i}": float(r.choice([100, 1000, 20_000])) for i in range(6)}
    for rec, d in length.items():
        t = 0.0
        while t < d and rec != "r5":  # r5 has no coverage
            t += r.choice([0, 1, 40, 900])
            end = min(d, t + r.choice([1, 5, 300, 5000]))
            if t < d:
                spans.append((rec, t, end))
            t = end + r.choice([1, 7])
        rows += [(rec, s, s + r.choice([.5, 3, 60]), i) for i, s in enumerate(round(r.uniform(0, d), 1) for _ in range(80))] + [(rec, d - 1, d + 50, 99), (rec, d + 500, d + 600, 100)]
    df = spark.createDataFrame(rows, "recording_id string, start_s double, end_s double, i int")
    cov = spark.createDataFrame(spans, "recording_id string, start_s double, end_s double")
    dur = spark.createDataFrame([x for x in length.items() if x[0] != "r4"], "recording_id string, duration_s double")  # r4's length is not known
    full = spark.createDataFrame([("r1",), ("r5",)], "recording_id string")

    def kept(open_end, complete=()):
        out = []
        for rec, s, e, i in rows:
            last = max((x for x in spans if x[0] == rec and x[1] <= s), default=None)
            inside = last and (e <= last[2] + 1e-6 or open_end and rec != "r4" and last[2] >= length[rec] - 1e-6)
            if rec in complete or inside:
                out.append((rec, s, e, i))
        return sorted(out)
    got = lambda x: sorted(tuple(y) for y in x.select("recording_id", "start_s", "end_s", "i").collect())
    for block in (3.0, 500.0, 1e6):
        assert got(iv.within(df, cov, block)) == kept(False)
        assert got(iv.within_or_last(df, cov, dur, block)) == kept(True)
        assert got(closed_time_only(df, cov, full, dur, block)) == kept(True, ("r1", "r5"))
    assert iv.within(df, cov.limit(0), 10.0).count() == 0


def test_no_join_on_the_recording_alone_for_rows(spark):
    df = spark.createDataFrame([("r", 1.0, 2.0)], "recording_id string, start_s double, end_s double")
    plan = iv.within(df, df, 10.0)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("_blk" in x for x in joins)


def test_pack_rows_walks_a_task_once(spark):
    import random
    r = random.Random(5)
    rows = [(f"v{i % 40}", float(s), float(s + r.choice([1, 5, 30])), i) for i, s in enumerate(r.randrange(60) for _ in range(800))]
    b = spark.createDataFrame(rows, "view string, start_s double, end_s double, tie long")
    want, free = {}, {}
    for v, s, e, tie in sorted(rows, key=lambda x: (x[0], x[1], x[3])):
        at = free.setdefault(v, [])
        lane = next((i for i, t in enumerate(at) if s >= t - 1e-9), len(at))
        at[lane:lane + 1] = [e]
        want[tie] = lane
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # views go on from batch to batch
    try:
        packed = iv.pack_rows(b, ["view"], "view string, start_s double, end_s double, tie long, row long")
        assert {x.tie: x.row for x in packed.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().executedPlan().toString()
