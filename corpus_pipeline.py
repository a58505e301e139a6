"""A corpus from raw documents: toxic texts go, near-duplicates and benchmark leaks go, secrets are masked, and the rest
is mixed by source. Each stage is (spark, docs, sf_dir) -> DataFrame and sees what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import decontaminate, mixing, neardup, secrets, toxicity
from chorale.llm.store import Scratch, table

#: Fixed value: the columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; null and empty texts have no toxic window."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs.select(*COLUMNS), model, name="toxicity_").where(F.col("toxicity_") < toxicity.THRESHOLD).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similarity 0.8 or more: that with the smallest id. Of rows that repeat
    its id with texts of the same group one stays, the smallest text hash; texts without words all stay."""
    scratch = Scratch(spark)
    found = scratch.cut(neardup.near_duplicates(docs, scratch, percent=80).where("kept"))
    # rows that share id and group: one (text hash, row) of them is enough
    groups = found.where("class is not null").groupBy("doc_id", "class").agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("rows"))
    alone = found.where("class is null").select("doc_id", "th").distinct().withColumn("rows", F.lit(1))
    stay = groups.select("doc_id", "th", "rows").union(alone.select("doc_id", "th", F.col("rows").cast("long"))).withColumnsRenamed({"doc_id": "k_id", "th": "k_th"})
    rows = docs.select(*COLUMNS).withColumn("th_", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th_") == F.col("k_th")))
    single = rows.where("rows = 1").select(*COLUMNS)
    several = rows.where("rows > 1").select(*COLUMNS, "th_")
    once = several.dropDuplicates(["doc_id", "th_"]).select(*COLUMNS)
    return scratch.keep(single.union(once))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not one with other numbers or names. Each text is judged by itself,
    also where rows repeat an id or have none."""
    scratch = Scratch(spark)
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), scratch).select(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"))
    rows = docs.select(*COLUMNS).withColumn("th_", F.xxhash64("text"))
    return scratch.keep(rows.join(scratch.cut(found.distinct()), F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("th_") == F.col("l_th")), "left_anti").select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    scratch = Scratch(spark)
    return scratch.keep(mixing.mix(docs, scratch))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_leaks), ("secrets", without_secrets), ("mixing", mixed)]

#: The first stage compresses with trained dictionaries, which SQL cannot express; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return scratch.keep(docs)
