import re

from chorale.llm.lines import repeated_units, stripped
from chorale.llm.store import Scratch
from odd_rows import SF, no_docs, odd_docs  # noqa: F401


def pieces(text):
    for m in re.finditer(r"[^\n]+", text or ""):
        yield "line", m.start(), m.end()
        parts = list(re.finditer(r"(?:[^.!?]|[.!?](?![^\w\s]*[ \t]))*(?:[.!?][^\w\s]*[ \t]+)?", m[0]))
        parts = [p for p in parts if p[0]]
        if len(parts) > 1:
            for p in parts:
                yield "sentence", m.start() + p.start(), m.start() + p.end()


def test_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    seen, want = {}, []
    for d, t in rows:
        for level, a, b in pieces(t):
            words = re.findall(r"[^\W_]+", t[a:b].lower())
            if len(words) < 8:
                continue
            cut = t[a:b].strip()
            a += t[a:b].index(cut)
            key = level, " ".join(words)
            if key in seen:
                want.append((d, level, a, a + len(cut), seen[key]))
            else:
                seen[key] = d
    got = [tuple(r) for r in repeated_units(docs, Scratch(spark)).collect()]
    assert sorted(got) == sorted(want) and want


def test_removal_keeps_offsets(spark, no_docs):
    s = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, s, 0), (2, f"Intro.\n{s}\nlast words", 0), (3, f"{s}. But more follows here", 0), (4, None, 0)], "doc_id long, text string, digest int")
    gone = repeated_units(docs, Scratch(spark))
    assert {(r["doc_id"], r["level"]) for r in gone.collect()} == {(2, "line")}
    got = {r["doc_id"]: r for r in stripped(docs, gone).collect()}
    assert got[1]["text"] == s and got[2]["text"] == "Intro.\n\nlast words" and got[4]["text"] is None
    assert [tuple(x) for x in got[2]["kept_spans"]] == [(0, 7), (7 + len(s), 7 + len(s) + 11)]


def test_sentences_inside_lines(spark):
    s = "Some words that many texts share, and that go on for long enough. "
    docs = spark.createDataFrame([(1, "First of all. " + s + "End of it"), (2, "Another start! " + s.upper() + "another end")], "doc_id long, text string")
    got = [tuple(r) for r in repeated_units(docs, Scratch(spark)).collect()]
    assert got == [(2, "sentence", 15, 15 + len(s) - 1, 1)]


def test_odd_rows(spark, odd_docs, no_docs):
    got = repeated_units(odd_docs, Scratch(spark)).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(2, 1)}
    assert repeated_units(no_docs, Scratch(spark)).count() == 0
