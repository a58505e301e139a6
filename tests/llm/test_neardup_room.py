"""Members of a large family by way of their rarest shingles: what cannot be alike is not compared, what is alike still meets."""

import random

from pyspark.sql import functions as F

from chorale.llm import neardup as nd
from chorale.llm.store import Scratch

PERCENT = 80


def _texts(n):
    """One family: 90 words that all share, with up to five of them replaced by words of the text's own."""
    r = random.Random(3)
    base = [f"c{i}" for i in range(90)]
    out = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(0, 90, 6), i % 6):
            w[at] = f"o{i}x{at}"
        out.append(" ".join(w))
    return out


def _met(rows):
    keys = rows.select("key", "fp", "label")
    both = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.label") != F.col("b.label")))
    return {(bytes(r[0]).decode(), bytes(r[1]).decode()) for r in both.select("a.fp", "b.fp").distinct().collect()}


def test_every_link_meets_and_most_of_a_family_does_not(spark):
    texts = _texts(120)
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    name = [f"{i:03d}" for i in range(len(texts))]
    links = {(name[i], name[j]) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= PERCENT * len(sets[i] | sets[j])}
    links = {tuple(sorted(x)) for x in links}
    table = spark.createDataFrame([(name[i].encode(), t, len(sets[i])) for i, t in enumerate(texts)], "fp binary, text string, n long")
    scratch = Scratch(spark)
    own = scratch.cut(nd._rarest(table, PERCENT, 5).join(table.select("fp", "n", F.col("fp").alias("label")), "fp"))
    rows = nd._within_room(own, PERCENT, scratch)
    assert links and links <= _met(rows)
    assert len(_met(rows)) < len(_met(own)) / 2
    assert rows.count() < own.count() / 4
    scratch.clear()


def test_a_row_meets_no_row_of_its_own_label(spark):
    rows = [(1, 100, b"a", 100, b"x"), (1, 100, b"b", 100, b"x"), (2, 100, b"a", 100, b"x"), (2, 100, b"c", 100, b"y"), (3, 92, b"a", 100, b"x"), (3, 92, b"c", 85, b"y"),
            (4, 88, b"a", 100, b"x"), (4, 100, b"c", 100, b"y")]
    first = spark.createDataFrame(rows, "key long, room long, fp binary, n long, label binary")
    scratch = Scratch(spark)
    got = sorted((r["key"], bytes(r["fp"]), r["size"]) for r in nd._within_room(first, 85, scratch).collect())
    # key 3: 92 may hold 0.85 * 185 / 1.85 = 85 of them; key 4: 88 are fewer than the 91.9 that two sets of 100 would share
    assert got == [(2, b"a", 2), (2, b"c", 2), (3, b"a", 2), (3, b"c", 2)]
    scratch.clear()
