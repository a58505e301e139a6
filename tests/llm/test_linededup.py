import hashlib
import random

from chorale.llm import catalog
from chorale.llm.linededup import without_repeated_lines
from chorale.llm.store import Scratch
from odd_rows import SF, no_docs, odd_docs  # noqa: F401

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, least_docs=2, least_chars=10):
    """Rows (doc_id, text); ids compare with None last."""
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        first = lambda k: min((i for i in held[k] if i is not None), default=None)
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= max(2, least_docs) and d != first(key(x)))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(df, **kw):
    rows = without_repeated_lines(df, Scratch(df.sparkSession), **kw).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, rows), key=str)


def test_random_lines_with_unicode_blanks_and_repeats(spark):
    r = random.Random(5)
    pool = ["A common line of text", " a COMMON line of text\t", "É common line of text", "é common line of text", "short", "nine char", "ten chars!", "", "   ", "\x85 odd blank line", "zero\x00byte line here", "ünïcödé 10"]
    rows = [(i if i % 9 else None, "\n".join(r.choice(pool) if r.random() < .7 else f"own line number {r.randrange(60)}" for _ in range(r.randrange(12)))) for i in range(200)]
    rows += [(7, rows[7][1])] * 3 + [(8, "A common line of text\nother words of a second row")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == plain(rows)
    assert run(df, least_docs=5, least_chars=1) == plain(rows, 5, 1)


def test_a_line_in_every_document_is_found_on_the_hot_side_and_the_cold(spark):
    rows = [(i, f"the same header for all\nbody {i} is not shared\npair line of {i // 2:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(df) == plain(rows)


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    rows = [tuple(x) for x in odd_docs.select("doc_id", "text").collect()]
    more = odd_docs.selectExpr("*", "1 as d", "2 as th", "3 as gone", "4 as row", "5 as a", "6 as t_", "7 as n_lines")
    assert run(more) == plain(rows)
    out = without_repeated_lines(more, Scratch(spark))
    assert set(out.columns) == set(more.columns) | {"n_dropped", "kept_text"} and out.where("gone <> 3 or row <> 4 or t_ <> 6").count() == 0
    assert run(no_docs) == []


def test_one_very_long_text(spark):
    text = "\n".join(f"line number {i % 5000}" for i in range(60_000))
    rows = [(2, text), (1, "line number 17\nline number 18 \n")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_query_hashes_the_kept_text(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain(rows)}
    assert {tuple(x) for x in catalog.QUERIES["op13_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
