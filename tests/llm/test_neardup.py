import random

from chorale.llm.neardup import near_duplicates
from chorale.llm.store import Scratch
from odd_rows import no_docs, odd_docs  # noqa: F401


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """Component of every row number, by all pairs."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(s):
        for j in range(i):
            b = s[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], s


def test_against_all_pairs(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return w
    hub = text(150)
    rows = [hub] + [edited(hub, r.choice([1, 1, 2, 2, 3, 4, 6])) for _ in range(180)]  # a star about one text, larger than a node may be
    chain = text(120)
    for _ in range(25):
        rows.append(chain)
        chain = edited(chain, 1)
    common = text(40)
    rows += [common + text(60) for _ in range(90)]  # a passage that many unlike texts share
    rows += [text(r.randrange(1, 8)) for _ in range(20)] + [["a", "b"], ["A", "b"], [], []]
    rows += rows[:40]
    r.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    root, s = brute(rows, 85)
    low = {}
    for i, x in enumerate(root):
        low.setdefault(x, i)
    got = {x["doc_id"]: x for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), percent=85).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, x in enumerate(root) if got[i]["component_id"] != low[x]]
    assert wrong == []
    assert all(got[i]["n_shingles"] == len(s[i]) and got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs, Scratch(spark)).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for r in by[1] + by[2]} == {1} and not by[2][0]["kept"]
    assert by[6][0]["kept"] and by[7][0]["component_id"] == 6
    for i in (3, 4, 8):
        assert by[i][0]["kept"] and by[i][0]["component_id"] == i and by[i][0]["n_shingles"] == 0
    assert by[5][0]["n_shingles"] == 19_996
    null = sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in by[None])
    assert null[0] == (0, None, True) and null[1][1:] == (1, False)
    assert near_duplicates(no_docs, Scratch(spark)).count() == 0
