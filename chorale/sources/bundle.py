"""The tables of a checking bundle: numbered candidates with their clip, answers, truth, references, species, recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.operators.calibrate import KEY

CONTEXT_S = 0.5


def number_rows(df: DataFrame, group: str, order: list[str], block_s: float, name: str) -> DataFrame:
    """Dense 0-based ids in (group, order) order: counts per time block give offsets, rows are numbered inside a block."""
    d = df.withColumn("_blk", F.floor(F.col(order[0]) / block_s))
    per = d.groupBy(group, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    # first by group (one row each), then inside the group by block
    g = per.groupBy(group).agg(F.sum("_c").alias("_gc"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    g = g.select(group, F.coalesce(F.sum("_gc").over(before), F.lit(0)).alias("_go"))
    inside = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(group, "_blk", F.coalesce(F.sum("_c").over(inside), F.lit(0)).alias("_bo")).join(g, group)
    i = F.row_number().over(Window.partitionBy(group, "_blk").orderBy(*order)) - 1
    return d.withColumn("_i", i).join(off, [group, "_blk"]).withColumn(name, F.col("_go") + F.col("_bo") + F.col("_i")).drop(
        "_blk", "_i", "_go", "_bo")


def candidates(kept: DataFrame, run_id: str, block_s: float) -> DataFrame:
    """Kept candidates with ids and a clip per window."""
    clips = number_rows(kept.select("recording_id", "start_s").distinct(), "recording_id", ["start_s"], block_s, "w")
    c = number_rows(kept, "recording_id", ["start_s", "species_key"], block_s, "candidate_id")
    return c.join(clips, ["recording_id", "start_s"]).withColumn("clip", F.format_string("clips/w%06d", "w")).withColumn("model", F.lit(run_id)).drop("w")


def clip_manifest(cand: DataFrame) -> DataFrame:
    """One clip per window with context either side."""
    return cand.groupBy("clip").agg(F.first("recording_id").alias("recording_id"), (F.min("start_s") - CONTEXT_S).alias("clip_start_s"),
                                    (F.max("end_s") + CONTEXT_S).alias("clip_end_s"))


def known_answers(cand: DataFrame, checks: DataFrame) -> DataFrame:
    return cand.join(checks.where("verdict <> 'unsure'"), KEY).select("candidate_id", "verdict", "reference", "labeller")


def truth_rows(annotations: DataFrame, coverage: DataFrame, label: str) -> DataFrame:
    """Boxes and closed segments in one table."""
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    a = annotations.select("recording_id", F.lit("box").alias("kind"), "start_s", "end_s", "low_hz", "high_hz", "species_key", F.lit(label).alias("labeller"))
    return a.unionByName(coverage.select("recording_id", F.lit("segment").alias("kind"), "start_s", "end_s", null_d.alias("low_hz"), null_d.alias("high_hz"),
                                         null_s.alias("species_key"), F.lit(label).alias("labeller")))


def species_rows(species: DataFrame, cand: DataFrame) -> DataFrame:
    return species.join(cand.select("species_key").distinct(), "species_key", "left_semi").select("species_key", F.col("name").alias("common_name"), F.lit("").alias("group"))


def recording_rows(recordings: DataFrame, cand: DataFrame) -> DataFrame:
    return recordings.join(cand.select("recording_id").distinct(), "recording_id", "left_semi").select(
        "recording_id", "duration_s", F.coalesce("start_time", F.lit("")).alias("start_time"), F.coalesce("site", F.lit("")).alias("site"))


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
