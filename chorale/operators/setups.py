"""Frozen survey setups: which can be used, what they may claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.survey import bar_of
from chorale.params import SurveyRule


def complete_runs(scored: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that scored every recording, by distinct (run, recording) pairs."""
    n = recordings.agg(F.count(F.lit(1))).scalar()
    per = scored.select(*keys, "recording_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("scored"))
    return per.where(F.col("scored") >= n)


def usable(setups: DataFrame, scored: DataFrame, recordings: DataFrame) -> DataFrame:
    """Setups whose model has a complete run here; ``scored``: (run_id, identity, recording_id)."""
    full = complete_runs(scored, recordings, ["run_id", "identity"])
    return setups.join(full.select(F.col("identity").alias("model")).distinct(), "model", "left_semi")


def claim(score: DataFrame, rule: SurveyRule, label: str) -> DataFrame:
    """One line per model saying what its lists can be trusted to mean."""
    f, c = rule.firm, rule.check
    share = lambda x: F.when(F.col(x).isNotNull(), F.concat(F.format_string("%.0f", F.col(x) * 100), F.lit("%"))).otherwise("—")
    text = F.concat(
        F.col(label), F.lit(f": firm after {f.k} detections at {bar_of(f)}, checked after {c.k} at {bar_of(c)}. Measured on "),
        F.col("n_recordings").cast("string"), F.lit(" recording(s) ("), F.format_string("%.1f", F.col("hours")),
        F.lit(" h): firm calls right "), share("firm_precision"), F.lit(", birds found after checking "), share("recall_reviewed"))
    return score.withColumn("claim", text)
