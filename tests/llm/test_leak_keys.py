"""Rows that share an id, or have none, are judged one by one for benchmark leaks."""

import corpus_pipeline as p
from odd_rows import DOC, SF


def test_a_leak_takes_no_other_row_of_its_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(i, t, "en", "a", 1) for i in (None, 7) for t in (item, "clean words " * 20, "another text that is clean", None)]
    got = p.without_leaks(spark, spark.createDataFrame(rows, DOC), SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows if r[1] != item)
