import pytest
from pyspark.sql import functions as F

from chorale import schemas
from chorale.operators import crosscheck as cc
from chorale.operators.index import derive_detections

VOCAB = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [("r", rec, 3.0 * w, 3.0 * w + 3, [((w * 7 + i * 3 + len(rec)) % 10) / 10 for i in range(3)]) for rec in ("x", "yy", "zzz") for w in range(20)]
    return spark.createDataFrame(rows, schemas.SCORE_WINDOWS)


def check(stored, rebuilt, matrix):
    return {r.recording_id: r for r in cc.cross_check(stored, rebuilt, matrix, VOCAB, ["b"], 0.3).collect()}


def test_a_true_index_agrees(matrix):
    det = derive_detections(matrix, VOCAB, 1, 0.3)
    got = check(det, det, matrix)
    assert set(got) == {"x", "yy", "zzz"} and all(r.agrees and r.mass_gap < 1e-6 and r.windows_index == r.windows_matrix > 0 for r in got.values())
    assert sum(r.index_rows for r in got.values()) == det.count()


def test_each_kind_of_fault_is_found(matrix):
    det = derive_detections(matrix, VOCAB, 1, 0.3)
    first = (F.col("start_s") == 3.0) & (F.col("rank_in_window") == 1)
    lost = check(det.where(~((F.col("recording_id") == "x") & first)), det, matrix)
    assert (lost["x"].only_index, lost["x"].only_matrix, lost["x"].agrees, lost["yy"].agrees) == (0, 1, False, True)
    twice = check(det.union(det.where((F.col("recording_id") == "yy") & first)), det, matrix)
    assert (twice["yy"].only_index, twice["yy"].only_matrix, twice["yy"].agrees, twice["x"].agrees) == (1, 0, False, True)
    raised = det.withColumn("score_raw", F.when((F.col("recording_id") == "zzz") & first, F.lit(1.5).cast("float")).otherwise(F.col("score_raw")))
    got = check(raised, det, matrix)["zzz"]
    assert (got.only_index, got.only_matrix, got.agrees) == (1, 1, False)
    gone = check(det.where("recording_id <> 'x'"), det, matrix)["x"]
    assert gone.index_rows == 0 and gone.windows_index == 0 < gone.windows_matrix and not gone.agrees
    ghost = check(det.union(det.where("recording_id = 'x'").withColumn("recording_id", F.lit("none"))), det, matrix)["none"]
    assert ghost.windows_matrix == 0 < ghost.windows_index and not ghost.agrees


def test_a_floor_over_theta_shows_in_the_masses(matrix):
    """Rows agree with a rebuild of the same policy, but the index does not reach down to theta."""
    det = derive_detections(matrix, VOCAB, 1, 0.9)
    got = check(det, det, matrix)
    assert all(r.only_index == r.only_matrix == 0 for r in got.values()) and not all(r.agrees for r in got.values())


def test_empty(matrix):
    det = derive_detections(matrix, VOCAB, 1, 0.3)
    assert check(det.limit(0), det.limit(0), matrix.limit(0)) == {}
