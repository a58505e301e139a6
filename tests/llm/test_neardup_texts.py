"""Texts are shuffled once, however often links are checked."""

from pyspark.sql import functions as F

from chorale.llm import neardup as nd
from chorale.llm.store import Scratch

ROWS = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h i"), (None, "p q r s t u"), (3, ""), (4, None)]


def test_checks_read_texts_where_they_lie(spark):
    scratch = Scratch(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    texts = nd._stored_texts(docs, scratch, "doc_id", "text")
    assert texts.count() == 4  # a row that is there twice is one text
    rows = docs.where("text <> ''").distinct().withColumn("th", F.xxhash64("text"))
    entities = rows.select(F.encode("text", "utf-8").alias("fp"), nd._place("doc_id", "th").alias("at"))
    a, b = (bytearray(ROWS[i][1].encode()) for i in (0, 2))
    pairs = spark.createDataFrame([(a, b)], "a binary, b binary")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = nd._confirmed(pairs, entities, texts, 80, 5)
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2
        assert links.count() == 1 and nd._confirmed(pairs, entities, texts, 81, 5).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        scratch.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_")]
