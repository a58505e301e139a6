import random

from chorale.llm.store import Scratch
from chorale.llm.topk import sparse_rows, top_k


def brute(rows, k):
    out = []
    for q, a in rows.items():
        s = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows.items() if c != q))[:k]
        out += [(q, r + 1, c, -v) for r, (v, c) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k, **blocks):
    df = sparse_rows(spark.createDataFrame(list(rows.items()), "id long, w array<long>"), "id", "w")
    return sorted(map(tuple, top_k(df, df, k, **blocks).collect()))


def test_blocks_ties_and_sparse_rows(spark):
    r = random.Random(3)
    rows = {i: [r.choice([0, 0, 1, -2, 3]) for _ in range(9)] for i in range(90)}
    for i in range(90, 110):
        rows[i] = rows[5]  # equal vectors: ties
    assert run(spark, rows, 4, candidate_block=30, query_block=40) == brute(rows, 4)


def test_large_weights_fewer_candidates_empty_vectors(spark):
    rows = {1: [2 ** 20, 5], 2: [2 ** 20, -7], 3: []}
    assert run(spark, rows, 5) == brute(rows, 5)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2], 9), (1, [1, 2], 9), (2, None, 9), (None, [1, 1], 9), (3, [None, 1], 9), (4, [3, 0], 9)], "id long, w array<long>, score int")
    s = sparse_rows(df, "id", "w")
    assert sorted(r["id"] for r in s.collect()) == [1, 4]
    assert sorted(map(tuple, top_k(s, s, 3).collect())) == [(1, 1, 4, 3), (4, 1, 1, 3)]
    assert top_k(s.limit(0), s.limit(0), 3).count() == 0
    assert Scratch(spark).made == []
