"""Run manifests: identities, labels, completeness, cross-checks between artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readout_token(transform: Column) -> Column:
    """softmax, sigmoid, identity, or ''."""
    return F.regexp_extract(F.lower(F.ltrim(transform)), r"^(?:per-class )?(softmax|sigmoid|identity)", 1)


def identity(runs: DataFrame) -> DataFrame:
    tok = readout_token(F.col("score_transform"))
    return runs.withColumn("readout", tok).withColumn("identity", F.concat_ws(
        " ", "model_name", "model_version", F.when(tok == "", "unknown-readout").otherwise(tok)))


def arm_labels(runs: DataFrame) -> DataFrame:
    """A display label per run, unique in the set: the readout where it differs, the run id's tail where not.

    Label groups are runs of one model version; the manifest table is small.
    """
    base = F.concat_ws("-", "model_name", "model_version")
    tok, tail = readout_token(F.col("score_transform")), F.substring("run_id", -8, 8)
    a = runs.withColumn("_b", base).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_b")))
    a = a.withColumn("_l", F.when(F.col("_n") == 1, F.col("_b")).when(tok != "", F.concat("_b", F.lit(" ("), tok, F.lit(")"))).otherwise(
        F.concat("_b", F.lit(" ["), tail, F.lit("]"))))
    a = a.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("_l")))
    return a.withColumn("label", F.when(F.col("_m") > 1, F.concat("_l", F.lit(" ["), tail, F.lit("]"))).otherwise(F.col("_l"))).drop(
        "_b", "_n", "_l", "_m")


def comparable(runs: DataFrame) -> DataFrame:
    """Softmax scores share a window's mass, so they do not compare across windows."""
    soft = readout_token(F.col("score_transform")) == "softmax"
    return runs.withColumn("across_window_comparable", ~soft).withColumn(
        "caveat", F.when(soft, "softmax scores compete within a window; thresholds do not transfer across windows").otherwise(""))


def embedding_mismatch(scores: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Windows present on one side only; must be empty for an embedding arm."""
    a = scores.select(*keys).distinct().withColumn("_s", F.lit(True))
    b = embeddings.select(*keys).distinct().withColumn("_e", F.lit(True))
    return a.join(b, keys, "full_outer").where(F.col("_s").isNull() | F.col("_e").isNull()).select(
        *keys, F.when(F.col("_s").isNull(), "no scores").otherwise("no embedding").alias("missing"))


def leaked(recordings: DataFrame, training: DataFrame) -> DataFrame:
    """Recordings seen in training; must be empty unless allowed."""
    return recordings.join(training.select("recording_id").distinct(), "recording_id", "left_semi")


def content_ref(df: DataFrame, name: str) -> DataFrame:
    """A content-addressed ref of a working copy: order-free sum of row hashes, and count, in one aggregation. Repeated
    rows add up, and a null is told from its absence."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(c) for c in cols], *[F.isnull(c) for c in cols])
    total = F.coalesce(F.pmod(F.sum(h.cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(total.cast("long").alias("h"), F.count(F.lit(1)).alias("n")).select(F.concat(
        F.lit(f"{name}@w"), F.substring(F.lower(F.lpad(F.hex(F.col("h").bitwiseXOR(F.xxhash64("n"))), 16, "0")), 1, 10)).alias("ref"))


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """(name, version): versions only from '@v<digits>'."""
    digits = F.regexp_extract(ref, r"@v([0-9]+)$", 1)
    return F.substring_index(ref, "@", 1), F.when(digits != "", digits).try_cast("bigint")


def describe_ref(df: DataFrame) -> DataFrame:
    name, version = parse_ref(F.col("ref"))
    d = df.withColumn("name", name).withColumn("version", version)
    return d.withColumn("described", F.when(F.col("name") == "imported", "the imported annotations").when(
        F.col("version").isNotNull(), F.concat("name", F.lit(" v"), F.col("version").cast("string"))).otherwise(
        F.concat("name", F.lit(" (working copy)"))))


def index_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either index the other lacks (as multisets)."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("first only")).unionByName(
        b.select(*cols).exceptAll(a).withColumn("side", F.lit("second only")))
