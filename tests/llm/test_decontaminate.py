import re

from chorale.llm.decontaminate import find_leaks
from chorale.llm.store import Scratch
from odd_rows import SF, no_docs, odd_docs  # noqa: F401

ITEM = "A train leaves at 14 km from the town and Alice counts 12 cars while Bob counts 12 cars as well before sunset."


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, bench, Scratch(spark)).collect()}


def test_verbatim_passages_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: re.sub(r"\s+", " ", t.lower())
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if flat(b["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, Scratch(spark)).collect()}
    assert got == want and want


def test_other_numbers_and_names_are_caught_if_consistent(spark):
    texts = [ITEM, "x " + ITEM.replace("12", "31").replace("Alice", "Carol").replace("Bob", "Dave").replace("14", "9") + " y", ITEM.replace("12", "31", 1), "unlike text " * 30,
             " ".join(ITEM.split()[:8]), ITEM.replace("14 km", "14 miles")]
    got = leaks(spark, texts, [ITEM])
    assert {d for d, _ in got} == {0, 1, 5}
    assert got[0, 0]["exact"] and not got[1, 0]["exact"] and not got[5, 0]["exact"]


def test_short_items_and_templates_of_placeholders(spark):
    got = leaks(spark, ["so what is the answer here, then", "what is the", "12 13 14 15 16 17 18 19"], ["What is the answer here", "two words", "1 2 3 4 5 6 7 8 9", None, ""])
    assert set(got) == {(0, 0)}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two words"), (2, "seven wise owls watch from an old oak tree near the river bank at night"), (None, "x"), (3, None)], "item_id long, text string")
    got = find_leaks(odd_docs, bench, Scratch(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 2), (2, 2), (None, 2)}
    assert find_leaks(no_docs, bench, Scratch(spark)).count() == 0
    assert find_leaks(odd_docs, bench.limit(0), Scratch(spark)).count() == 0
