"""Table contracts: fixed schemas, and validators that list every violation at once.

Each validator is one aggregation pass over the table (a count per rule); the error names
all rules broken, not the first one. NULL stands for "unknown" inside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _F, _I, _B, _L = (T.StringType(), T.DoubleType(), T.FloatType(), T.IntegerType(),
                          T.BooleanType(), T.LongType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RECORDINGS = _struct(("recording_id", _S), ("path", _S), ("duration_s", _D), ("sample_rate", _I),
                     ("channels", _I), ("start_time", _S), ("site", _S), ("lat", _D), ("lon", _D),
                     ("labelled", _B))
ANNOTATIONS = _struct(("recording_id", _S), ("start_s", _D), ("end_s", _D), ("low_hz", _D),
                      ("high_hz", _D), ("species_key", _S))
BOXES = _struct(*[(f.name, f.dataType) for f in ANNOTATIONS], ("box_id", _S), ("labeller", _S),
                ("labelled_at", _S), ("assisted", _B))
CHUNKS = _struct(("recording_id", _S), ("start_s", _D), ("end_s", _D), ("state", _S),
                 ("closed_by", _S), ("closed_at", _S), ("reopen_reason", _S))
SAMPLE = _struct(("recording_id", _S), ("start_s", _D), ("end_s", _D), ("order", _I),
                 ("stratum", _S), ("whole", _B))
DETECTIONS = _struct(("recording_id", _S), ("run_id", _S), ("start_s", _D), ("end_s", _D),
                     ("species_key", _S), ("score_raw", _F), ("occ_score", _F), ("suppressed", _B),
                     ("rank_in_window", _I))
SCORE_WINDOWS = _struct(("run_id", _S), ("recording_id", _S), ("start_s", _D), ("end_s", _D),
                        ("scores", T.ArrayType(_F)))
ALIGNED = _struct(("recording_id", _S), ("start_s", _D), ("end_s", _D), ("species_key", _S),
                  ("y_true", T.ByteType()), ("score", _F))
RUNS = _struct(("run_id", _S), ("model_name", _S), ("model_version", _S), ("window_s", _D),
               ("hop_s", _D), ("score_transform", _S), ("dataset", _S),
               ("geofilter", T.MapType(_S, _S)), ("packages", T.MapType(_S, _S)), ("created_utc", _S))
CHECKS = _struct(("recording_id", _S), ("start_s", _D), ("species_key", _S), ("verdict", _S),
                 ("reference", _B), ("labeller", _S), ("at", _S))
THETAS = _struct(("model", _S), ("species_key", _S), ("theta", _D), ("source", _S), ("reason", _S))


class SchemaError(ValueError):
    """Every contract violation of one table, in one message."""


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def column_problems(df: DataFrame, schema: T.StructType, name: str) -> list[str]:
    """Missing and extra columns and wrong types, all of them; touches no data."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    out = [f"{name}: missing column {c}" for c in want if c not in have]
    out += [f"{name}: unexpected column {c}" for c in have if c not in want]
    out += [f"{name}.{c}: expected {want[c].simpleString()}, got {have[c].simpleString()}"
            for c in want if c in have and have[c] != want[c]]
    return out


def recordings_rules() -> dict[str, Column]:
    return {
        **{f"null {c}": F.col(c).isNull() for c in ("recording_id", "path", "duration_s", "labelled")},
        "non-positive duration_s": F.col("duration_s") <= 0,
    }


def annotations_rules() -> dict[str, Column]:
    return {
        **{f"null {c}": F.col(c).isNull() for c in ("recording_id", "start_s", "end_s", "species_key")},
        "end_s <= start_s": F.col("end_s") <= F.col("start_s"),
    }


def detections_rules() -> dict[str, Column]:
    needed = ("recording_id", "run_id", "start_s", "end_s", "species_key", "score_raw", "suppressed",
              "rank_in_window")
    return {
        **{f"null {c}": F.col(c).isNull() for c in needed},
        "end_s <= start_s": F.col("end_s") <= F.col("start_s"),
        "score_raw outside [0, 1]": (F.col("score_raw") < 0) | (F.col("score_raw") > 1),
        "rank_in_window < 1": F.col("rank_in_window") < 1,
    }


RULES = {"recordings": (RECORDINGS, recordings_rules), "annotations": (ANNOTATIONS, annotations_rules),
         "detections": (DETECTIONS, detections_rules)}


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) rows from one pass; the unpivot runs on the single aggregate row."""
    names = list(rules)
    one = df.agg(*[F.count_if(rules[n]).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations"))
                      for i, n in enumerate(names)])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def duplicate_ids(df: DataFrame, key: str = "recording_id") -> DataFrame:
    """Surplus rows of a key that must be unique. Grouped counts combine map-side."""
    return df.groupBy(key).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")
    ).select(F.lit(f"{key} is not unique").alias("rule"), "violations")


def violations(df: DataFrame, table: str) -> DataFrame:
    """All data rules of a contract with how often each is broken."""
    _, rules = RULES[table]
    out = rule_counts(df, rules())
    return out.unionByName(duplicate_ids(df)) if table == "recordings" else out


def validate(df: DataFrame, table: str) -> DataFrame:
    """Return ``df`` unchanged, or raise one SchemaError that lists everything wrong."""
    problems = column_problems(df, RULES[table][0], table)
    if not problems:
        # at most a dozen rows: one per rule
        problems = [f"{table}: {r.rule} ({r.violations} rows)"
                    for r in violations(df, table).where("violations > 0").collect()]
    if problems:
        raise SchemaError("; ".join(problems))
    return df
