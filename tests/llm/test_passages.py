"""Passages inside lines, short lines, and sentences that are lines elsewhere."""

import re

from chorale.llm.lines import repeated_passages, repeated_units
from chorale.llm.store import Scratch
from odd_rows import SF


def test_passages_against_all_windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {d: [m.span() for m in re.finditer(r"[^\W_]+", t or "")] for d, t in texts.items()}
    seen, want = {}, set()
    for d in sorted(texts):
        w = [texts[d][a:b].lower() for a, b in words[d]]
        for i in range(len(w) - 49):
            first = seen.setdefault(tuple(w[i:i + 50]), (d, i))
            if first[0] != d or i >= first[1] + 50:
                want |= {(d, j) for j in range(i, i + 50)}
    spans = repeated_passages(docs, Scratch(spark)).collect()
    got = {(r["doc_id"], j) for r in spans for j, (a, b) in enumerate(words[r["doc_id"]]) if r["start"] <= a and b <= r["stop"]}
    assert got == want and want


def test_a_passage_in_mid_line(spark):
    p = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"some start {p} and an end"), (2, f"another {p} here"), (3, p.rsplit(" ", 1)[0])], "doc_id long, text string")
    assert [tuple(r) for r in repeated_passages(docs, Scratch(spark)).collect()] == [(2, "passage", 8, 8 + len(p), 1)]


def test_short_lines_and_sentences_alone_on_a_line(spark):
    s = "one two three four five six seven eight nine."
    docs = spark.createDataFrame([(1, f"{s}\nMenu"), (2, f"{s} But more follows here\nmenu\n"), (3, f"{s} -\n")], "doc_id long, text string")
    got = {(r["doc_id"], r["level"]) for r in repeated_units(docs, Scratch(spark), least_line=1, across=True).collect()}
    assert got == {(2, "sentence"), (2, "line"), (3, "line")}
