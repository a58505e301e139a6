import random

import numpy as np
import pytest

from chorale.llm import negatives
from chorale.llm.negatives import Index, hard_negatives, vectors
from chorale.llm.store import Scratch

COLS = "vec_id long, label int, w array<long>"


def plain(rows, every, positives=5, most=3, low=50, high=95):
    rows = [(i, l, w) for i, l, w in rows if l is not None and w is not None and None not in w]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, l, w in rows:
        if i is None or i % every:
            continue
        found = sorted(((dot(w, v), j, m) for j, m, v in rows if j != i), key=key)
        for ps, p, _ in [x for x in found if x[2] == l][:positives]:
            for n, (s, j, _) in enumerate([x for x in found if x[2] != l and low * ps <= 100 * x[0] <= high * ps][:most]):
                out.append((i, p, n + 1, j, ps, s))
    return sorted(out, key=str)


def run(spark, df, every=5, **kw):
    scratch = Scratch(spark)
    rows = scratch.cut(vectors(df, "vec_id", "label", "w"))
    got = hard_negatives(rows.where(f"id % {every} = 0"), rows, scratch, **kw)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def gauss(r, i, dims=20, labels=4, spread=60):
    label = r.randrange(labels)
    return (i, label, [int(r.gauss(30 if k % labels == label else 0, spread * 0.9 ** k)) for k in range(dims)])


@pytest.mark.parametrize("blocks", [{}, {"row_block": 40, "query_block": 9}])
def test_windows_fill_as_in_plain_search(spark, blocks):
    r = random.Random(4)
    rows = [gauss(r, i) for i in range(260)]
    assert run(spark, spark.createDataFrame(rows, COLS), **blocks) == plain(rows, 5)
    assert run(spark, spark.createDataFrame(rows, COLS), positives=2, negatives=6, low=-40, high=60, **blocks) == plain(rows, 5, 2, 6, -40, 60)


def test_ties_copies_zero_negative_and_shared_ids(spark):
    r = random.Random(6)
    rows = [(i, i % 3, [4, 0, 2]) for i in range(40)] + [(i, i % 2, [r.randrange(-3, 4) for _ in range(3)]) for i in range(40, 90)]
    rows += [(5, 1, [9, 9, 9]), (5, 1, [9, 9, 9]), (5, 2, [4, 0, 2]), (None, 1, [4, 0, 2]), (None, 0, [3, 3, 3]), (100, 7, [0, 0, 0]), (101, 7, [0, 0, 0]), (105, 8, [-1, 0, 0]), (106, 8, [1, 0, 0]), (110, 9, [1])]
    assert run(spark, spark.createDataFrame(rows, COLS), row_block=30) == plain(rows, 5)


def test_nulls_large_numbers_lengths_extra_columns_and_empty(spark):
    big = 2 ** 29
    rows = [(5, 1, [big, 3, -big]), (6, 1, [big, 1, -big]), (7, 2, [big, 0, 0]), (8, 2, [big // 2, 5, -big]), (9, None, [1, 2, 3]), (10, 1, None), (11, 1, [1, None, 3]), (15, 2, []), (20, 1, [2, 1]), (25, 1, [2, 1, 7, 9])]
    df = spark.createDataFrame(rows, COLS).selectExpr("*", "1 as r", "2 as v", "3 as id", "4 as norm")
    assert run(spark, df) == plain(rows, 5)
    too_large = [(5, 1, [2 ** 40, 1]), (6, 1, [1, 1]), (10, 1, [2, 2]), (11, 2, [1, 1])]
    assert run(spark, spark.createDataFrame(too_large, COLS)) == plain(too_large[1:], 5)
    assert run(spark, df.limit(0)) == []


def test_tails_stay_out_of_the_index_and_no_pair_is_lost():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 64)) * 200 * 0.93 ** np.arange(64)).astype(np.int64)
    q, full = x[:20], x[:20] @ x.T
    for least in (int(np.quantile(full, 0.9)), int(np.quantile(full, 0.999)), -5, 0):
        high = float(np.sqrt((q ** 2).sum(axis=1)).max())
        index = Index(x, high, float(least), int(np.abs(q).max()))
        i, j, s = index.search(q, np.full(20, least))
        assert {(a, b, c) for a, b, c in zip(i, j, s)} == {(a, b, full[a, b]) for a, b in zip(*np.nonzero(full >= least))}
        assert (index.kept < 64).any() == (least > 0)


def test_later_rounds_only_ask_open_windows(spark, monkeypatch):
    asked = []
    true = negatives.join_windows
    monkeypatch.setattr(negatives, "join_windows", lambda w, *a, **k: (asked.append(w.count()), true(w, *a, **k))[1])
    r = random.Random(9)
    rows = [gauss(r, i, spread=40) for i in range(300)]
    assert run(spark, spark.createDataFrame(rows, COLS)) == plain(rows, 5)
    assert len(asked) > 3 and asked[0] == 60 and min(asked) < 60
