import hashlib
import random
import zlib

import numpy as np
import pytest

from chorale.llm import catalog
from chorale.llm.periodic import fragments_of, periodic_runs, with_runs
from odd_rows import SF, no_docs, odd_docs  # noqa: F401


def plain(w):
    """All runs of a list by comparing it with itself shifted by every period."""
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(24, 3 * q) and not any(q % p == 0 and s <= i and s + m >= i + n for s, m, p in out if p < q):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def stitched(found):
    out, spans = [], {}
    for q, x, y in sorted(set(found)):
        last = spans.setdefault(q, [])
        if last and x <= last[-1][1]:
            last[-1][1] = max(last[-1][1], y)
        else:
            last.append([x, y])
    for q, parts in spans.items():
        out += [(x, y - x + q, q) for x, y in parts if y - x + q >= max(24, 3 * q)]
    return sorted(out)


def periodic_words(r, n):
    out = []
    while len(out) < n:
        p = r.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 31, 32, 33, 64, 90])
        u = [r.randrange(r.choice([2, 3, 40])) for _ in range(p)]
        out += (u * r.randrange(1, 9))[:-r.randrange(p) or None] + [r.randrange(50) for _ in range(r.choice([0, 0, 5, 30]))]
    return out[:n]


@pytest.mark.parametrize("tile", [256, 512, 1 << 15])
def test_fragments_stitch_to_all_runs_at_any_tile(tile):
    r = random.Random(tile)
    texts = [periodic_words(r, r.randrange(700)) for _ in range(60)] + [[0] * 600, [0, 1] * 300, ([0] * 99 + [1]) * 5, list(range(500)), []]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for w in [*texts, b]:
        assert stitched(fragments_of(np.array(w, np.int64), tile)) == plain(w)


def test_long_text_over_many_tiles(spark):
    w = [f"w{i}" for i in range(40_000)] + [f"r{i % 5000}" for i in range(60_000)] + ["x"] * 70_000 + [f"z{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    got = sorted((r["start"], r["length"], r["period"]) for r in periodic_runs(df).collect())
    assert got == [(40_000, 60_000, 5000), (100_000, 70_000, 1)]


def judged(rows, df, **kw):
    want = []
    for d, t in rows:
        w = [x.decode() for x in t.encode().split()] if t else []
        runs = plain(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        want.append((d, runs, best, " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], tuple(r["strongest"]) if r["strongest"] else None, r["collapsed"]) for r in with_runs(df, **kw).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_random_texts_repeats_and_shared_ids(spark):
    r = random.Random(8)
    rows = [(i % 30 or None, r.choice([" ", "\n", " \t\x0b"]).join(f"é{x}" for x in periodic_words(r, r.randrange(200)))) for i in range(90)]
    rows += [rows[3]] * 3 + [(5, "no break\x85here " * 30), (5, " ".join("ab" * 40))]
    judged(rows, spark.createDataFrame(rows, "doc_id long, text string"), tile=256)


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    rows = [tuple(x) for x in odd_docs.select("doc_id", "text").collect()]
    more = odd_docs.selectExpr("*", "1 as d", "2 as th", "3 as row", "4 as q", "5 as start", "6 as made", "7 as t_", "8 as runs")
    short = [x for x in rows if x[1] is None or len(x[1]) < 9000]
    judged(short, more.where("text is null or length(text) < 9000"))
    out = with_runs(more)
    assert out.count() == len(rows) and set(out.columns) == set(more.columns) | {"strongest", "collapsed"}
    assert out.where("made <> 6 or start <> 5 or row <> 3").count() == 0
    assert with_runs(no_docs).count() == 0 and periodic_runs(no_docs).count() == 0


def test_query_repeats_one_text_in_ten_and_hashes(spark):
    want = set()
    for d, t in [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]:
        w, h = [x.decode() for x in (t or "").encode().split()], zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w) if h % 10 == 0 or len(w) < 400 else None
        if runs is not None:
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            want.add((d, len(runs), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = {tuple(x) for x in catalog.QUERIES["op12_periodic_runs"](spark, SF).select("doc_id", "n_runs", "runs_sha256", "collapsed_sha256").collect()}
    assert len(want) > 100 and want <= got
