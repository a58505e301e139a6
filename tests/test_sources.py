import random
import struct

import pytest
from pyspark.sql import functions as F

from chorale import schemas
from chorale.operators import outcomes as oc
from chorale.operators import thresholds as th
from chorale.operators.labelsets import draw_sample, quotas
from chorale.params import RuleSpec
from chorale.sources import annotations as an
from chorale.sources import bundle as bd
from chorale.sources import imports as im
from chorale.sources import tables as st

REC = [("SNE_001_20180509_050002", "SNE_001_20180509_050002.wav", 60.0, 32000, 1, "", "s", None, None, True), ("b", "sub/b.flac", 60.0, 32000, 1, "", "s", None, None, False)]


def wav(path, seconds, rate=8000):
    n = int(seconds * rate) * 2
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"LIST" + struct.pack("<I", 4) + b"INFO"
                     + b"data" + struct.pack("<I", n) + b"\0" * n)


def test_scan_folder(spark, tmp_path):
    (tmp_path / "site").mkdir()
    wav(tmp_path / "SNE_001_20180509_050002.wav", 2.5)
    wav(tmp_path / "site" / "5AFC0A30.wav", 1)
    got = {r.recording_id: r for r in im.scan_folder(spark, str(tmp_path), "x").collect()}
    a, b = got["SNE_001_20180509_050002"], got["site__5AFC0A30"]
    assert (a.duration_s, a.sample_rate, a.channels, a.start_time) == (2.5, 8000, 1, "2018-05-09T05:00:02")
    assert b.start_time.endswith("Z") and b.path == "site/5AFC0A30.wav"
    schemas.validate(im.scan_folder(spark, str(tmp_path)), "recordings")


def test_validate_lists_everything(spark):
    d = spark.createDataFrame([("a", "p", -1.0, 1, 1, "", "", None, None, None), ("a", "p", 5.0, 1, 1, "", "", None, None, True)], schemas.RECORDINGS)
    with pytest.raises(schemas.SchemaError) as e:
        schemas.validate(d, "recordings")
    for part in ("null labelled", "non-positive duration_s", "not unique"):
        assert part in str(e.value)
    with pytest.raises(schemas.SchemaError) as e:
        schemas.validate(d.drop("site").withColumn("more", F.lit(1)), "recordings")
    assert "missing column site" in str(e.value) and "unexpected column more" in str(e.value)


def test_import_reports_every_problem(spark):
    r = spark.createDataFrame(REC, schemas.RECORDINGS)
    t = spark.createDataFrame([("b.wav", "0", "3", "Turdus merula", "1.5"), ("zz.wav", "0", "3", "Turdus merula", "x"), ("b.wav", "5", "4", "a_b", "0.5"), ("q", "1", "2", "a", "0.1")],
                              "file string, start string, end string, label string, confidence string")
    with pytest.raises(im.ImportProblem) as e:
        im.prepare(t, r, "run")
    for part in ("empty or non-numeric", "not in this project", "outside 0 to 1", "ends before"):
        assert part in str(e.value)
    with pytest.raises(im.ImportProblem, match="score"):
        im.resolve_columns(["file", "start", "label"])


def test_import_csv_and_parquet(spark, tmp_path):
    r = spark.createDataFrame(REC, schemas.RECORDINGS)
    rows = spark.createDataFrame([("b.flac", "0", "3", "turdus MERULA_Blackbird", "0.5"), ("b.flac", "0", "3", "Turdus merula", "0.9"), ("b.flac", "0", "3", "Noise", "0.7")],
                                 "file string, start string, end string, label string, confidence string")
    st.write_csv(rows, str(tmp_path / "t.csv"))
    rows.write.parquet(str(tmp_path / "t.parquet"))
    for p in ("t.csv", "t.parquet"):
        det = im.prepare(im.read_table(spark, str(tmp_path / p)), r, "run")
        assert sorted((x.species_key, round(x.score_raw, 3), x.rank_in_window) for x in det.collect()) == [("Noise", .7, 2), ("Turdus merula", .9, 1)]


@pytest.mark.parametrize("kind,text", [
    ("exchange", "Filename,Start Time (s),End Time (s),Low Freq (Hz),High Freq (Hz),Species\nb.flac,1,2,100,200,robin\nb.flac,3,3,,,robin\nb.flac,4,6,,,mystery\n"),
    ("selections", "Selection\tBegin File\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tAnnotation\n1\tx/b.flac\t1\t2\t100\t200\trobin\n2\tx/b.flac\t4\t6\t\t\tmystery\n"),
    ("tracks", "1\t2\trobin\n\\\t100\t200\n4\t6\tmystery\n")])
def test_annotation_files(spark, tmp_path, kind, text):
    p = tmp_path / ("b.txt" if kind == "tracks" else "f.csv")
    p.write_text(text)
    r = spark.createDataFrame(REC, schemas.RECORDINGS)
    lk = spark.createDataFrame([("robin", "Turdus migratorius")], "name string, species_key string")
    raw = an.READERS[kind](spark, str(p))
    if kind == "tracks":
        raw = raw.withColumn("file", F.lit("b.flac"))
    boxes, unmapped, unknown = an.resolve_boxes(raw, r, lk)
    assert [tuple(x) for x in boxes.collect()] == [("b", 1.0, 2.0, 100.0, 200.0, "Turdus migratorius")]
    assert [x.name for x in unmapped.collect()] == ["mystery"] and unknown.count() == 0


def test_profile_and_names(spark, tmp_path):
    bad = spark.createDataFrame([("Turdus merula", "1", "x"), ("turdus  MERULA", "2", ""), ("", "9", "")], "species_key string, tier string, common_name string")
    with pytest.raises(im.ImportProblem) as e:
        im.load_profile(bad, "p")
    assert all(x in str(e.value) for x in ("empty species_key", "tier not in", "duplicate"))
    ok = im.load_profile(bad.limit(1), "p").first()
    assert (ok.species_key, ok.tier, ok.extras) == ("Turdus merula", 1, {"common_name": "x"})
    (tmp_path / "labels.txt").write_text("Turdus merula_Eurasian Blackbird\nnothing\n")
    assert [(x.species_key, x.common_name) for x in im.read_label_names(spark, str(tmp_path / "labels.txt")).collect()] == [("Turdus merula", "Eurasian Blackbird")]


def test_aligned_store_prunes_old_working_copies(spark, tmp_path):
    a = spark.createDataFrame([("runA", "r", 0., 1., "a", 1, .5)], "run_id string, recording_id string, start_s double, end_s double, species_key string, y_true int, score float")
    for ref, at in (("night@w1", "2024-01-01"), ("night@w2", "2024-01-02"), ("imported", "2024-01-03")):
        st.write_aligned(a, str(tmp_path), "ds", "native", ref, at)
    assert [r.truth_ref for r in st.list_aligned(spark, str(tmp_path)).collect()][0] == "imported"
    assert st.prune_working(spark, str(tmp_path), "ds", "night", "night@w2") == 1
    assert sorted(r.truth_ref for r in st.list_aligned(spark, str(tmp_path)).collect()) == ["imported", "night@w2"]


def test_threshold_set_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("m", "a", .4, "rule", ""), ("m", None, None, "none", "")], schemas.THETAS)
    s = th.build_set("night", rows)
    th.save_set(s, str(tmp_path))
    th.save_set(th.build_set("dawn", rows), str(tmp_path))
    assert th.load_set(spark, str(tmp_path), "night").count() == 2
    back = th.set_from_json(th.set_to_json(s, RuleSpec()))
    assert sorted((r.part, r.theta or 0) for r in back.collect()) == [("default", 0), ("snapshot", .4)]
    spec = RuleSpec(kind="fixed", fixed={"m": 0.25}, min_labelled=3)
    assert th.spec_from_document({**th.spec_document(spec), "unknown": "1"}) == spec and th.curve_rule(spec) is None
    with pytest.raises(ValueError):
        th.curve_rule(RuleSpec(kind="none such"))


def test_unasked_box_is_outside_every_rate(spark):
    lab = spark.createDataFrame([("r", 0., 3., "a", 1, .9, True, False), ("r", 3., 6., "a", 0, .1, False, False)],
                                "recording_id string, start_s double, end_s double, species_key string, y_true int, score float, hit boolean, hidden boolean")
    ann = spark.createDataFrame([("r", 2.9, 3.2, "a", "1"), ("r", 0., 2., "a", "2")], "recording_id string, start_s double, end_s double, species_key string, box_id string")
    got = {r.box_id: r.outcome for r in oc.vocalisation_outcomes(oc.box_coverage(lab, ann, [], [], 3.0)).collect()}
    assert got == {"1": "not asked", "2": "found"}


def test_false_events_merge_consecutive_windows(spark):
    rows = [("r", float(t), float(t + 3), "a", 0, .9, True, False) for t in (0, 3, 6, 12, 15, 30)] + [("r", 40., 43., "a", 0, .9, True, True)]
    lab = spark.createDataFrame(rows, "recording_id string, start_s double, end_s double, species_key string, y_true int, score float, hit boolean, hidden boolean")
    for block in (5.0, 1000.0):
        assert oc.false_events(lab, [], block).first().events == 3


def plain_quotas(sizes, n):
    """Places handed out one by one."""
    n = min(n, sum(sizes.values()))
    share = {k: n * v / sum(sizes.values()) for k, v in sizes.items()}
    got = {k: min(v, max(1, int(share[k]))) for k, v in sizes.items()}
    for k in sorted(sizes, key=lambda k: (share[k], k)):
        while sum(got.values()) > n and got[k]:
            got[k] -= 1
    for k in sorted(sizes, key=lambda k: (share[k] - got[k], k), reverse=True):
        if sum(got.values()) < n and got[k] < sizes[k]:
            got[k] += 1
    return got


def test_quotas_of_random_strata(spark):
    r = random.Random(3)
    worlds = [({"a": 90, "b": 9, "c": 1}, 10), ({f"s{i}": 3 for i in range(10)}, 4)] + [
        ({f"s{i:02d}": r.choice([1, 2, 3, 5, 40, 400]) for i in range(r.randrange(1, 25))}, r.choice([0, 1, 7, 30, 200, 5000])) for _ in range(12)]
    for sizes, n in worlds:
        got = {x.stratum: x.quota for x in quotas(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), n).collect()}
        assert got == plain_quotas(sizes, n), (sizes, n)
        assert sum(got.values()) == min(n, sum(sizes.values()))


def sites(spark, n=9):
    return spark.createDataFrame([(f"r{i}", 600.0, f"site{i % 3}", "2024-01-01T05:00:00") for i in range(n)], "recording_id string, duration_s double, site string, start_time string")


def test_sample_spreads_and_is_extended_never_redrawn(spark):
    s = draw_sample(sites(spark), 12, 1)
    got = sorted(s.collect(), key=lambda x: x.order)
    assert [x.order for x in got] == list(range(12)) and len({x.recording_id for x in got}) == 9
    assert len({x.stratum for x in got[:3]}) == 3
    more = sorted(draw_sample(sites(spark), 3, 2, existing=s).collect(), key=lambda x: x.order)
    assert more[:12] == got and [x.order for x in more] == list(range(15)) and len({(x.recording_id, x.start_s) for x in more}) == 15


def test_sample_takes_whole_recordings_across_sites(spark):
    s = sorted(draw_sample(sites(spark), 4, 0, whole_recordings=2).collect(), key=lambda x: x.order)
    whole = [x for x in s if x.whole]
    assert [x.order for x in s] == list(range(24)) and s[:20] == whole and len(s) == 24
    names = sorted({x.recording_id for x in whole})
    assert len(names) == 2 and len({int(x[1:]) % 3 for x in names}) == 2 and [x.recording_id for x in whole] == [names[0]] * 10 + [names[1]] * 10
    assert [x.start_s for x in whole[:10]] == [60.0 * i for i in range(10)] and not {x.recording_id for x in s[20:]} & set(names)
    again = draw_sample(sites(spark), 0, 5, existing=spark.createDataFrame(s), whole_recordings=1).where("whole").select("recording_id").distinct()
    assert again.count() == 3 and draw_sample(sites(spark).limit(0), 5).count() == 0


def test_bundle_numbers_are_dense(spark):
    d = spark.createDataFrame([(f"r{i % 3}", float(i * 7 % 50), i) for i in range(60)], "recording_id string, start_s double, i int")
    got = bd.number_rows(d, "recording_id", ["start_s", "i"], 10.0, "id").collect()
    want = sorted((x.recording_id, x.start_s, x.i) for x in got)
    assert [(x.recording_id, x.start_s, x.i) for x in sorted(got, key=lambda x: x.id)] == want and sorted(x.id for x in got) == list(range(60))


def test_score_run_resumes(spark):
    r = spark.createDataFrame(REC, schemas.RECORDINGS)

    def scorer(batches):
        for pdf in batches:
            yield pdf.assign(scores=[[.5, .1]] * len(pdf))
    s = im.score_run(r, r.where("recording_id = 'b'"), 3.0, 3.0, scorer, "m")
    assert s.count() == 20 and s.select("recording_id").distinct().first()[0].startswith("SNE")
    assert im.window_count_warnings(s, r, 3.0, 3.0).count() == 0
    assert im.window_count_warnings(s.limit(10), r, 3.0, 3.0).count() == 1

def test_scan_folder_any_case_and_long_headers(spark, tmp_path):
    wav(tmp_path / "a.wav", 1)
    wav(tmp_path / "B.WAV", 2)
    plain = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "c.wav").write_bytes(plain[:12] + b"bext" + (5001).to_bytes(4, "little") + b"x" * 5002 + plain[12:])
    got = {r.path: r.duration_s for r in im.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 1.0, "B.WAV": 2.0, "c.wav": 1.0}
    (tmp_path / "none").mkdir()
    with pytest.raises(im.ImportProblem):
        im.scan_folder(spark, str(tmp_path / "none"))


def test_scan_folder_with_odd_file_names(spark, tmp_path):
    names = ["a b.wav", "c#d.wav", "50%20 e.wav", "été?.wav"]
    for i, n in enumerate(names):
        wav(tmp_path / n, i + 1)
    assert {r.path: r.duration_s for r in im.scan_folder(spark, str(tmp_path)).collect()} == {n: i + 1.0 for i, n in enumerate(names)}


def test_content_ref_tells_repeats_and_nulls(spark):
    from chorale.operators.runs import content_ref
    ref = lambda rows: content_ref(spark.createDataFrame(rows, "a string, b string"), "x").first()["ref"]
    assert ref([("a", "b")] * 2) != ref([("c", "d")] * 2)
    assert ref([("x", None)]) != ref([(None, "x")])
    assert ref([("a", "b"), ("c", None)]) == ref([("c", None), ("a", "b")])


def test_ambiguous_file_names_are_reported(spark):
    from chorale.sources.annotations import resolve_boxes
    rec = spark.createDataFrame([("a__x", "s1/x.wav", 60.0), ("b__x", "s2/x.wav", 60.0), ("y", "s1/y.wav", 60.0), ("z", "s1/y2.wav", 60.0)], "recording_id string, path string, duration_s double")
    rows = spark.createDataFrame([(f, 1.0, 2.0, None, None, "n") for f in ("x.wav", "y.wav", "a__x.wav", "y2.txt")], "file string, start_s double, end_s double, low_hz double, high_hz double, name string")
    boxes, _, unknown = resolve_boxes(rows, rec, spark.createDataFrame([("n", "Turdus merula")], "name string, species_key string"))
    assert sorted(r["recording_id"] for r in boxes.collect()) == ["a__x", "y", "z"]
    assert [r["file"] for r in unknown.collect()] == ["x.wav"]
    table = spark.createDataFrame([("x.wav", "0", "3", "Turdus merula", "0.5"), ("y", "0", "3", "Turdus merula", "0.5")], "file string, start string, end string, species string, score string")
    assert {r["recording"]: r["recording_id"] for r in im.canonical_rows(table, rec).collect()} == {"x.wav": None, "y": "y"}
