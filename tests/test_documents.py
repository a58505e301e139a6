import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from chorale import schemas
from chorale.sources import documents as dc

BOX = ("a", 1.0, 2.0, None, None, "Corvus corax", "b1", "p1", "", True)
REC = [("a", "a.wav", 120.0, 8000, 1, "", "s", None, None, True), ("b", "b.wav", 60.0, 8000, 1, "", "s", None, None, False)]
RUN = {"model_name": "m x/1", "model_version": "2", "window_s": 3.0, "hop_s": 3.0, "input_sr": 48000, "score_transform": "sigmoid"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([BOX, ("a", 5.0, 6.0, 1.0, 2.0, "Sitta canadensis", "b2", "p2", "", False)], schemas.BOXES)


def count(doc, table="boxes"):
    return doc.table(table, dc.LABEL_TABLES[table]).count()


def test_manifests(spark, tmp_path):
    p = str(tmp_path)
    assert dc.manifests(spark, p).count() == 0
    a = dc.save_manifest(spark, p, RUN)
    b = dc.save_manifest(spark, p, {**RUN, "geofilter": {"lat": "1"}, "created_utc": "2020-01-01T00:00:00+00:00"})
    assert a != b and a.startswith("m x/1-") and len(a) == len("m x/1-") + 8
    got = dc.manifests(spark, p).collect()
    assert [r.run_id for r in got] == [a, b]
    assert got[1].geofilter == {"lat": "1"} and got[0].geofilter == {} and got[0].input_sr == 48000
    assert got[0].created_utc.endswith("+00:00") and got[0].profile == ""
    with pytest.raises(FileExistsError):
        dc.save_manifest(spark, p, {**RUN, "run_id": a})
    with pytest.raises(schemas.SchemaError, match="window_s"):
        dc.save_manifest(spark, p, {k: v for k, v in RUN.items() if k != "window_s"})


def test_names():
    assert all(map(dc.usable_name, ("night", "A-1_b.c", "9", "x" * 64)))
    assert not any(map(dc.usable_name, ("", ".x", "a b", "imported", "x" * 65, "a/b", "é", "a\n")))


def test_sets_from_nothing_from_imported_and_from_a_copy(spark, tmp_path, rows):
    p, kind = str(tmp_path), dc.label_kind("my data")
    first = dc.create_set(spark, p, "my data", "one", "p1")
    assert [count(first, t) for t in dc.LABEL_TABLES] == [0, 0, 0]
    with pytest.raises(FileExistsError):
        dc.create_set(spark, p, "my data", "one", "p1")
    with pytest.raises(ValueError, match="name"):
        dc.create_set(spark, p, "my data", "imported", "p1")
    with pytest.raises(FileNotFoundError):
        dc.create_set(spark, p, "my data", "two", "p1", "nowhere")
    rec = spark.createDataFrame(REC, schemas.RECORDINGS)
    got = dc.create_set(spark, p, "my data", "two", "p1", dc.IMPORTED, (rec, rows.select(*schemas.ANNOTATIONS.names)))
    chunks = got.table("chunks", schemas.CHUNKS).collect()
    assert [(c.recording_id, c.start_s, c.state) for c in sorted(chunks, key=lambda c: c.start_s)] == [("a", 0.0, "closed"), ("a", 60.0, "closed")]
    boxes = got.table("boxes", schemas.BOXES).collect()
    assert len({b.box_id for b in boxes}) == 2 and {b.labeller for b in boxes} == {"imported"}
    dc.save_set(first, boxes=rows)
    copy = dc.create_set(spark, p, "my data", "three", "p3", "one")
    assert count(copy) == 2 and copy.head.derived_from == "one" and copy.head.author == "p3"
    dc.save_set(copy, boxes=rows.limit(0))
    assert count(dc.load(spark, p, kind, "one")) == 2 and count(dc.load(spark, p, kind, "three")) == 0
    assert [r.name for r in dc.listed(dc.commits(spark, p, kind)).collect()] == ["one", "three", "two"]
    assert dc.commits(spark, p, dc.label_kind("other")).count() == 0


def test_stale_copies_are_refused(spark, tmp_path, rows):
    p = str(tmp_path)
    doc = dc.create_set(spark, p, "d", "one", "p1")
    other = dc.load(spark, p, doc.head.kind, "one")
    dc.save_set(doc, boxes=rows)
    folders = len(os.listdir(tmp_path / "data" / doc.head.kind / "n-one"))
    with pytest.raises(dc.StaleWrite):
        dc.save_set(other, boxes=rows.limit(0))
    with pytest.raises(dc.StaleWrite):
        dc.publish_set(other)
    assert len(os.listdir(tmp_path / "data" / doc.head.kind / "n-one")) == folders  # what was refused is gone
    assert count(dc.load(spark, p, doc.head.kind, "one")) == 2


def test_one_of_many_writers_wins(spark, tmp_path, rows):
    p = str(tmp_path)
    doc = dc.create_set(spark, p, "d", "one", "p1")

    def write(i):
        try:
            return dc.save_set(doc, author=f"w{i}", boxes=rows).head.author
        except dc.StaleWrite:
            return None
    with ThreadPoolExecutor(6) as pool:
        won = [w for w in pool.map(write, range(6)) if w]
    last = dc.load(spark, p, doc.head.kind, "one")
    assert won == [last.head.author] and last.head.number == 2 and count(last) == 2


def test_versions_stay_as_published(spark, tmp_path, rows):
    p = str(tmp_path)
    doc = dc.publish_set(dc.save_set(dc.create_set(spark, p, "d", "one", "p1"), boxes=rows))
    assert doc.head.published == 1
    doc = dc.publish_set(dc.save_set(doc, boxes=rows.limit(1)))
    doc = dc.save_set(doc, boxes=rows.limit(0))
    kind = doc.head.kind
    assert [count(dc.load(spark, p, kind, "one", v)) for v in (1, 2, None)] == [2, 1, 0]
    assert sorted(r.published for r in dc.versions(dc.commits(spark, p, kind)).collect()) == [1, 2]
    with pytest.raises(dc.FrozenVersion):
        dc.save_set(dc.load(spark, p, kind, "one", 1), boxes=rows)
    with pytest.raises(dc.FrozenVersion):
        dc.publish_set(dc.load(spark, p, kind, "one", 2))
    with pytest.raises(FileNotFoundError):
        dc.load(spark, p, kind, "one", 3)


def test_prune_keeps_what_is_referred_to(spark, tmp_path, rows):
    p = str(tmp_path)
    doc = dc.publish_set(dc.save_set(dc.create_set(spark, p, "d", "one", "p1"), boxes=rows))
    copied = dc.save_set(doc, boxes=rows.limit(1))
    dc.create_set(spark, p, "d", "two", "p1", "one")
    doc = dc.save_set(dc.save_set(copied, boxes=rows), boxes=rows.limit(0))
    assert dc.prune(spark, p, doc.head.kind) == 1 and dc.prune(spark, p, doc.head.kind) == 0
    assert [count(dc.load(spark, p, doc.head.kind, *x)) for x in (("one", 1), ("one",), ("two",))] == [2, 0, 1]


def test_put_list_delete_and_files_of_others(spark, tmp_path):
    p = str(tmp_path)
    theta = spark.createDataFrame([("x", 0.5)], "species_key string, theta double")
    dc.put(spark, p, "thresholds", "beta", {"rule": 1}, {"rows": theta}, at="2024-01-01")
    dc.put(spark, p, "thresholds", "Alpha", {"rule": 2}, at="2024-01-02")
    dc.put(spark, p, "thresholds", "beta", {"rule": 3}, at="2024-01-03")
    stray = tmp_path / "heads" / "thresholds" / "n-broken"
    stray.mkdir()
    (stray / "1.json").write_text("{not json")
    (stray / "notes.txt").write_text("hello")
    assert [tuple(r) for r in dc.listed(dc.commits(spark, p, "thresholds")).collect()] == [
        ("Alpha", "2024-01-02", "2024-01-02", 0), ("beta", "2024-01-01", "2024-01-03", 0)]
    doc = dc.load(spark, p, "thresholds", "beta")
    assert doc.body == {"rule": 3} and doc.table("rows", theta.schema).count() == 0
    dc.delete(spark, p, "thresholds", "beta")
    dc.delete(spark, p, "thresholds", "beta")
    dc.delete(spark, p, "thresholds", "never there")
    with pytest.raises(FileNotFoundError):
        dc.load(spark, p, "thresholds", "beta")
    again = dc.put(spark, p, "thresholds", "beta", {}, at="2024-02-01")
    assert again.head.created == "2024-02-01" and dc.listed(dc.commits(spark, p, "thresholds")).count() == 2


def test_columns_younger_than_the_files(spark, tmp_path, rows):
    doc = dc.put(spark, str(tmp_path), "old", "one", {}, {"boxes": rows.drop("assisted", "labelled_at")})
    got = doc.table("boxes", schemas.BOXES).collect()
    assert {(r.assisted, r.labelled_at) for r in got} == {(False, None)}
