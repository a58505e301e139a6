import hashlib
import base64

from pyspark.sql import functions as F

from chorale.llm import warc
from chorale.llm.store import Scratch


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_round_trip_groups_nulls_and_repeats(spark):
    big = "é<p>" * 50_000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(5, "http://a/\nb%", "same"), (3, "http://b/", "same"), (3, "http://b/", "same"), (None, None, "same"), (9, None, None), (8, "u", ""), (7, "v", big), (None, "w", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as payload").repartition(3)
    warc.register(spark)
    folder = Scratch(spark).path()
    warc.records(pages).write.format("warc").mode("append").save(folder)
    got = sorted((r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in spark.read.format("warc").load(folder).collect())
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        ids = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        first = min(ids) if ids else None
        kind = "response" if i == first else "revisit"
        name = lambda j: f"urn:page:{'null' if j is None else j}"
        want.append((name(i), kind, u, b32(data), len(data), None if kind == "response" else name(first), data if kind == "response" else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pushdown_skips_records_and_payloads(spark, monkeypatch):
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h', id % 4, '/') as url", "concat('page ', id % 30) as html")
    warc.register(spark)
    folder = Scratch(spark).path()
    warc.records(pages).write.format("warc").mode("append").save(folder)
    df = spark.read.format("warc").load(folder)
    assert df.where("record_type = 'revisit'").count() == 10
    assert df.where("target_uri = 'http://h1/' and payload_bytes >= 6").count() == 10
    bare = spark.read.format("warc").option("payload", "false").load(folder)
    assert bare.where("payload is not null").count() == 0 and bare.count() == 40
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, In, StringContains
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("payload_bytes",), (6,)), StringContains(("target_uri",), "h")]))
    assert [type(f) for f in left] == [StringContains]
    monkeypatch.setattr(warc, "_payload", lambda block: (_ for _ in ()).throw(AssertionError("decoded")))
    reader.tests.append(("eq", "record_type", "metadata"))
    assert [b for p in reader.partitions() for b in reader.read(p)] == []


def test_foreign_record_and_empty_folder(spark, tmp_path):
    body = b"plain body"
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body))
    warc.register(spark)
    r = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(x["record_id"], x["record_type"], bytes(x["payload"]), x["payload_bytes"]) for x in r] == [("urn:uuid:1", "resource", body, None)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_base32(spark):
    df = spark.createDataFrame([(bytes([i, 255 - i]) * i,) for i in range(40)], "b binary")
    assert all(r["x"] == b32(bytes(r["b"])) for r in df.select("b", warc.base32(F.sha1("b")).alias("x")).withColumn("x", F.col("x")).collect())
