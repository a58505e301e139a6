from chorale.llm.mixing import mix, targets
from chorale.llm.store import Scratch
from odd_rows import no_docs, odd_docs  # noqa: F401


def level(sizes, weights=(1, 2, 3), passes=3):
    """Repeatedly caps what is above and shares the rest by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > passes * sizes[s] + 1e-9]
        if not over:
            return {**goal, **capped}
        for s in over:
            capped[s] = passes * sizes[s]
            left -= capped[s]


def test_targets_against_repeated_sharing(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 5, None: 300}, {"a": 1, "b": 1, "c": 1}, {"x": 0, "y": 7}, {"a": 5}, {"b": 100, "a": 1, "é": 50, "z": 2, "A": 3}):
        got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = level(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_takes_come_near_targets_and_rerun_agrees(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 5) end as source", "repeat('w ', cast(1 + id % 17 as int)) as text", "1 as target")
    one = {r["doc_id"]: r for r in mix(docs, Scratch(spark)).collect()}
    two = {r["doc_id"]: r for r in mix(docs.repartition(7), Scratch(spark)).collect()}
    assert one == two and len(one) == 3000
    taken, goal = {}, {}
    for r in one.values():
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 20 for s in goal)
    assert sum(taken.values()) <= sum(r["size"] for r in one.values())


def test_odd_rows(spark, odd_docs, no_docs):
    got = mix(odd_docs, Scratch(spark)).collect()
    assert len(got) == odd_docs.count()
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 8)} == {0}
    assert mix(no_docs, Scratch(spark)).count() == 0
    only_empty = odd_docs.where("doc_id in (3, 4)")
    assert [r["taken"] for r in mix(only_empty, Scratch(spark)).collect()] == [0, 0]
