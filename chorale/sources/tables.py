"""Partitioned tables of a project: datasets, score matrices, the index, aligned frames, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale import schemas


def write_dataset(recordings: DataFrame, annotations: DataFrame | None, path: str, dataset: str) -> None:
    """Validated tables partitioned by dataset; rewriting a dataset replaces only its partition."""
    put(schemas.validate(recordings, "recordings").withColumn("dataset", F.lit(dataset)), f"{path}/recordings", ["dataset"])
    if annotations is not None:
        put(schemas.validate(annotations, "annotations").withColumn("dataset", F.lit(dataset)), f"{path}/annotations", ["dataset"])


def read_dataset(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    one = lambda t: spark.read.parquet(f"{path}/{t}").where(F.col("dataset") == dataset).drop("dataset")
    return one("recordings"), one("annotations")


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recordings").select("dataset").distinct()


def put(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_scores(score_windows: DataFrame, path: str) -> None:
    put(score_windows, f"{path}/scores", ["run_id"])


def read_scores(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/scores").where(F.col("run_id") == run_id)


def list_scores(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return read_scores(spark, path, run_id).select("recording_id").distinct()


def write_detections(det: DataFrame, path: str) -> None:
    cols = [f.name for f in schemas.DETECTIONS]
    put(schemas.validate(det.select(*cols), "detections"), f"{path}/detections", ["run_id"])


def read_detections(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    d = spark.read.parquet(f"{path}/detections")
    return d if run_id is None else d.where(F.col("run_id") == run_id)


ALIGNED_KEYS = ["dataset", "run_id", "grid", "truth_ref"]


def write_aligned(aligned: DataFrame, path: str, dataset: str, grid: str, truth_ref: str, created: str) -> None:
    """The aligned cache, one partition per (dataset, run, grid, truth); the creation time rides in a column."""
    put(aligned.withColumns({"dataset": F.lit(dataset), "grid": F.lit(grid), "truth_ref": F.lit(truth_ref), "created": F.lit(created)}),
        f"{path}/aligned", ALIGNED_KEYS)


def read_aligned(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    d = spark.read.parquet(f"{path}/aligned")
    for k, v in keys.items():
        d = d.where(F.col(k) == v)
    return d


def list_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Cached frames, newest first."""
    return spark.read.parquet(f"{path}/aligned").groupBy(*ALIGNED_KEYS).agg(F.max("created").alias("created")).orderBy(F.col("created").desc())


def stale_working(listed: DataFrame, dataset: str, set_name: str, keep: str) -> DataFrame:
    """Cached frames of superseded working copies of a set: the partitions to drop."""
    return listed.where((F.col("dataset") == dataset) & F.col("truth_ref").startswith(f"{set_name}@w") & (F.col("truth_ref") != keep))


def prune_working(spark: SparkSession, path: str, dataset: str, set_name: str, keep: str) -> int:
    """Drop those partitions (a handful of paths, through the table's own file system)."""
    doomed = stale_working(list_aligned(spark, path), dataset, set_name, keep).select(*ALIGNED_KEYS).collect()
    jvm = spark.sparkContext._jvm
    for r in doomed:
        p = jvm.org.apache.hadoop.fs.Path("/".join([f"{path}/aligned", *[f"{k}={r[k]}" for k in ALIGNED_KEYS]]))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(doomed)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with a header; one part per partition, so nothing is gathered."""
    df.write.mode("overwrite").option("header", True).csv(path)


def threshold_export(tables: dict[str, DataFrame], names: DataFrame, grid: str) -> DataFrame:
    """Per-species tables of all arms, with arm, common name and grid, for one file."""
    out = None
    for arm, t in tables.items():
        t = t.withColumn("arm", F.lit(arm)).withColumn("grid", F.lit(grid))
        out = t if out is None else out.unionByName(t)
    return out.join(names.select("species_key", "common_name"), "species_key", "left")


def detections_export(kept: DataFrame, checks: DataFrame) -> DataFrame:
    """The kept pool with the answers, where there are any."""
    key = ["recording_id", "start_s", "species_key"]
    return kept.join(checks.select(*key, "verdict"), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("")))
