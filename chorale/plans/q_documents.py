"""Queries of stored documents: manifests, label sets with versions, threshold sets, setups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.operators import survey as sv
from chorale.operators import thresholds as th
from chorale.plans import testbed as tb
from chorale.plans.q_survey import RULE, bars
from chorale.plans.q_thresholds import SPEC, _overrides, _resolved
from chorale.plans.registry import big, query, r6
from chorale.session import checkpoint_dir
from chorale.sources import documents as dc

SETUP_THETAS = T.StructType([T.StructField("species_key", T.StringType()), T.StructField("bar", T.StringType()), T.StructField("theta", T.DoubleType())])


def _store(spark) -> str:
    return f"{checkpoint_dir(spark)}/chorale-documents-{uuid.uuid4().hex[:12]}"


@query("B5_run_manifests", """SELECT run_id, 'model of ' || run_id AS model_name, window_s, row_number() OVER (ORDER BY created_utc DESC, run_id) AS place, detections, recordings
 FROM (SELECT run_id, w::DOUBLE AS window_s, CASE run_id WHEN 'runA' THEN '2024-01-01T00:00:00+00:00' ELSE '2024-01-02T00:00:00+00:00' END AS created_utc,
 count(*) AS detections, count(DISTINCT recording_id) AS recordings FROM e_det JOIN runs USING (run_id) GROUP BY 1, 2)""")
def b5(spark, d):
    p = _store(spark)
    for i, (run, (window, _)) in enumerate(tb.RUNS.items()):
        dc.save_manifest(spark, p, {
            "run_id": run, "model_name": f"model of {run}", "model_version": "1", "window_s": window, "hop_s": window, "input_sr": 48000,
            "score_transform": "identity", "created_utc": f"2024-01-0{i + 1}T00:00:00+00:00", "packages": {"spark": "4"}})
    place = F.row_number().over(Window.orderBy(F.desc("created_utc"), "run_id"))  # a row per run
    m = dc.manifests(spark, p).select("run_id", "model_name", "window_s", place.alias("place"))
    n = tb.detections(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("recording_id").alias("recordings"))
    return m.join(n, "run_id").select("run_id", "model_name", "window_s", *big("place", "detections", "recordings"))


@query("L3_L4_set_versions", """SELECT name, version, species_key, count(*) AS boxes, (SELECT 60 * count(*) FROM e_rec WHERE labelled)::BIGINT AS closed_chunks FROM (
 SELECT 'night' AS name, '1' AS version, species_key FROM e_ann
 UNION ALL SELECT 'night', '2', species_key FROM e_ann WHERE start_s % 2 = 0
 UNION ALL SELECT name, 'working', CASE WHEN high_hz >= 3000 THEN 'unknown bird' ELSE species_key END FROM e_ann, (VALUES ('night'), ('copy')) t(name) WHERE start_s % 2 = 0) GROUP BY 1, 2, 3""")
def l3_l4(spark, d):
    p = _store(spark)
    doc = dc.create_set(spark, p, "site", "night", "p1", dc.IMPORTED, (tb.recordings(spark, d), tb.annotations(spark, d)), tb.CHUNK_S)
    doc = dc.publish_set(doc)
    boxes = doc.table("boxes", dc.LABEL_TABLES["boxes"])
    doc = dc.publish_set(dc.save_set(doc, boxes=boxes.where("start_s % 2 = 0")))
    boxes = doc.table("boxes", dc.LABEL_TABLES["boxes"])
    doc = dc.save_set(doc, boxes=boxes.withColumn("species_key", F.when(F.col("high_hz") >= 3000, "unknown bird").otherwise(F.col("species_key"))))
    dc.create_set(spark, p, "site", "copy", "p2", "night")
    kind, out = dc.label_kind("site"), []
    for name, version in (("night", 1), ("night", 2), ("night", None), ("copy", None)):
        got = dc.load(spark, p, kind, name, version)
        closed = got.table("chunks", dc.LABEL_TABLES["chunks"]).agg(F.count_if(F.col("state") == "closed").alias("closed_chunks"))
        n = got.table("boxes", dc.LABEL_TABLES["boxes"]).groupBy("species_key").agg(F.count(F.lit(1)).alias("boxes"))
        out.append(n.join(closed, F.lit(True)).select(
            F.lit(name).alias("name"), F.lit(str(version or "working")).alias("version"), "species_key", *big("boxes", "closed_chunks")))
    return reduce(DataFrame.unionByName, out)


@query("T4_saved_sets", """SELECT name, created, updated, model, part, coalesce(species_key, '*') AS species_key, round(theta, 6) AS theta
 FROM (SELECT model, species_key, theta, CASE WHEN species_key IS NULL THEN 'default' ELSE 'snapshot' END AS part FROM t_res
 UNION ALL SELECT 'runA', species_key, 0.42, 'override' FROM spp WHERE idx = 4) JOIN (VALUES ('Dawn', '2024-01-02', '2024-01-02'), ('night', '2024-01-01', '2024-01-04')) n(name, created, updated) ON name = 'night' OR model = 'runB'""")
def t4_saved(spark, d):
    p = _store(spark)
    rows = th.build_set("night", _resolved(spark, d), _overrides(spark, d)).drop("set_name")
    rule = th.spec_document(SPEC)
    dc.put(spark, p, "thresholds", "night", rule, {"rows": rows.where("part = 'snapshot'")}, at="2024-01-01")
    dc.put(spark, p, "thresholds", "Dawn", rule, {"rows": rows.where("model = 'runB'")}, at="2024-01-02")
    dc.put(spark, p, "thresholds", "old", rule, {"rows": rows.where("model = 'runA'")}, at="2024-01-03")
    dc.put(spark, p, "thresholds", "night", rule, {"rows": rows}, at="2024-01-04")
    dc.delete(spark, p, "thresholds", "old")
    out = []
    for head in dc.listed(dc.commits(spark, p, "thresholds")).collect():
        doc = dc.load(spark, p, "thresholds", head.name)
        out.append(doc.table("rows", rows.schema).select(
            F.lit(head.name).alias("name"), F.lit(head.created).alias("created"), F.lit(head.updated).alias("updated"),
            "model", "part", F.coalesce("species_key", F.lit("*")).alias("species_key"), *r6("theta")))
    return reduce(DataFrame.unionByName, out)


@query("N1_saved_setups", """SELECT 'setup-' || run_id AS name, 2::BIGINT AS firm_k, species_key, 'p' || regexp_replace(printf('%.2f', floor), '0$', '') AS bar, round(theta, 6) AS theta
 FROM bars WHERE floor IN (0.5, 0.9) AND theta IS NOT NULL""")
def n1_saved(spark, d):
    p = _store(spark)
    payload = bars(spark, d).where(F.col("bar").isin(sv.bar_of(RULE.check), sv.bar_of(RULE.firm)) & F.col("species_key").isNotNull() & F.col("theta").isNotNull())
    for run in tb.RUNS:
        dc.put(spark, p, "setups", f"setup-{run}", {"model": run, "firm_k": RULE.firm.k, "check_k": RULE.check.k},
               {"thetas": payload.where(F.col("run_id") == run).select("species_key", "bar", F.col("theta").cast("double"))})
    out = []
    for head in dc.listed(dc.commits(spark, p, "setups")).collect():
        doc = dc.load(spark, p, "setups", head.name)
        out.append(doc.table("thetas", SETUP_THETAS).select(
            F.lit(head.name).alias("name"), F.lit(doc.body["firm_k"]).cast("long").alias("firm_k"), "species_key", "bar", *r6("theta")))
    return reduce(DataFrame.unionByName, out)
