"""Each stage of the pipeline against what its operator's brute force says of the stage's own input."""

import re

import corpus_pipeline as p
from chorale.llm import toxicity
from chorale.llm.secrets import scan_text
from chorale.llm.store import Scratch
from odd_rows import SF, no_docs, odd_docs  # noqa: F401
from test_neardup import brute


def test_stages(spark):
    scratch, docs, kept = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        docs = scratch.cut(stage(spark, docs, SF))
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name != "mixing":
            assert tuple(docs.columns) == p.COLUMNS, name
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(raw) - set(kept[0])
    assert sum(labels.get(d) == 0 for d in gone) <= 2
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(raw)
    again = toxicity.probabilities(model, [raw[i] for i in ids], toxicity.Distances(model) if len(model.weights) else None)
    assert gone == {i for i, s in zip(ids, again) if s >= 0.3}
    rows = sorted((d, r["text"]) for d, r in kept[0].items())
    root, _ = brute(rows, 80)
    first = {}
    for (d, _), x in zip(rows, root):
        first.setdefault(x, d)
    assert set(kept[1]) == set(first.values())
    flat = lambda t: re.sub(r"\s+", " ", t.lower())
    bench = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(kept[2]) == {d for d, r in kept[1].items() if not any(b in flat(r["text"]) for b in bench)}
    assert set(kept[3]) == set(kept[2]) and all(bool(scan_text(kept[2][d]["text"])) == (kept[2][d]["text"] != r["text"]) for d, r in kept[3].items())
    assert set(kept[4]) == set(kept[3]) and all(r["size"] == len(kept[3][d]["text"].split()) for d, r in kept[4].items() if kept[3][d]["text"].isascii())


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in p.STAGES:
            docs = Scratch(spark).cut(stage(spark, docs, SF))
        assert name == "mixing"
    near = p.without_near_duplicates(spark, odd_docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in near) == sorted(map(str, [1, 3, 4, 5, 6, 8, None]))
