"""WARC archives as a Spark data source, written and read in parallel.

Reading plans one partition per archive file (files are rolled at a bounded size when written), reads each record's
header block first, tests pushed-down predicates on record type and headers, and steps over the payload of a record that
fails them, or of every record when payloads are not asked for, without reading or decoding it.

Payloads are stored as HTTP bodies with gzip content coding inside uncompressed records, so a payload can be skipped by
its length. Paths go through pyarrow's file systems: local, HDFS, S3 and GCS addresses work alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage)

#: Bytes after which a writer starts its next file.
ROLL_BYTES = 64 << 20
#: Bytes of records handed to Spark at once.
BATCH_BYTES = 4 << 20

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, "
          "content_type string, payload binary")
#: Header of each column, as the format names it. Payload length is an extension field.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
           "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _clean(value: str) -> str:
    """A header value on one line: line ends and percent signs are percent-coded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(record_id: str, record_type: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit carries no payload, only its length and digest and the record that has it."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    body = b""
    if record_type != "revisit":
        body = gzip.compress(payload, compresslevel=1, mtime=0)
        http += [b"Content-Encoding: gzip", b"Content-Length: %d" % len(body)]
    block = b"\r\n".join(http) + b"\r\n\r\n" + body
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", _clean(uri)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if record_type == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head)])
    return lines.encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Buffered:
    """Sequential reading with cheap steps forward."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.buf, self.start = source, size, 0, b"", 0

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark, which is passed; None at the end of the file."""
        while True:
            here = self.buf.find(mark, self.at - self.start)
            if here >= 0:
                out = self.buf[self.at - self.start:here]
                self.at = self.start + here + len(mark)
                return out
            if self.start + len(self.buf) >= self.size:
                return None
            self._more(max(1 << 16, len(self.buf)))

    def take(self, n: int) -> bytes:
        while self.at + n > self.start + len(self.buf) and self.start + len(self.buf) < self.size:
            self._more(n)
        out = self.buf[self.at - self.start:self.at - self.start + n]
        if len(out) < n:
            raise ValueError("archive ends within a record")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise ValueError("archive ends within a record")
        if self.at > self.start + len(self.buf):
            self.buf, self.start = b"", self.at

    def _more(self, n: int) -> None:
        keep = self.buf[self.at - self.start:]
        self.source.seek(self.start + len(self.buf))
        self.buf, self.start = keep + self.source.read(max(n, 1 << 18)), self.at


def _headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a folded line goes on with the field before it."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _payload(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return block
    if _headers(head).get("content-encoding", "").lower() == "gzip" and body:
        return gzip.decompress(body)
    return body if sep else b""


def _fields(h: dict[str, str]) -> dict:
    bare = lambda v: v[1:-1] if v and v.startswith("<") and v.endswith(">") else v
    digest = h.get("warc-payload-digest")
    return {"record_id": bare(h.get("warc-record-id")), "record_type": h.get("warc-type"),
            "target_uri": _plain(h["warc-target-uri"]) if "warc-target-uri" in h else None,
            "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
            "payload_bytes": int(h["warc-payload-length"]) if "warc-payload-length" in h else None,
            "refers_to": bare(h.get("warc-refers-to")), "content_type": h.get("content-type")}


@dataclass
class _File(InputPartition):
    path: str
    size: int

    def __post_init__(self):
        super().__init__(self.path)


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringStartsWith: "starts", IsNotNull: "some"}
        for f in filters:
            column = f.attribute[0]
            if type(f) in kinds and len(f.attribute) == 1 and column in HEADERS:
                self.tests.append((kinds[type(f)], column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, base = _filesystem(self.path)
        found = system.get_file_info(base)
        files = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(base))
        return [_File(x.path, x.size) for x in sorted(files, key=lambda x: x.path)
                if x.type == pafs.FileType.File and posixpath.basename(x.path)[0] not in "._" and x.path.endswith(".warc")]

    def _wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if x is None or not (kind == "some" or kind == "eq" and x == value or kind == "in" and x in value or kind == "gt" and x > value
                                 or kind == "ge" and x >= value or kind == "lt" and x < value or kind == "le" and x <= value
                                 or kind == "starts" and x.startswith(value)):
                return False
        return True

    def read(self, partition):
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("content_type", pa.string()), ("payload", pa.binary())])
        if partition is None:  # a folder without archives
            return
        system, _ = _filesystem(self.path)
        rows, held = [], 0
        with system.open_input_file(partition.path) as source:
            data = _Buffered(source, partition.size)
            while data.at < data.size:
                head = data.until(b"\r\n\r\n")
                if head is None or not head.lstrip(b"\r\n").startswith(b"WARC/"):
                    raise ValueError(f"{partition.path}: no record at byte {data.at}")
                h = _headers(head.lstrip(b"\r\n"))
                n = int(h["content-length"])
                row = _fields(h)
                if self._wanted(row):
                    if self.payload and row["record_type"] not in ("revisit", "warcinfo"):
                        row["payload"] = _payload(data.take(n))
                        held += len(row["payload"])
                    else:
                        data.skip(n)
                        row["payload"] = None
                    rows.append(row)
                    held += 400
                else:
                    data.skip(n)
                data.skip(4)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own in a hidden folder; the commit moves the files of the tasks that count."""

    def __init__(self, options):
        self.path = options["path"]
        self.stage = f"_stage-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, base = _filesystem(self.path)
        folder = posixpath.join(base, self.stage)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "payload", "payload_digest", "refers_to")}
                for i in range(batch.num_rows):
                    r = {c: v[i].as_py() for c, v in cols.items()}
                    data = record_bytes(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["payload_digest"], r["refers_to"])
                    if out is not None and size + len(data) > ROLL_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        files.append(f"{uuid.uuid4().hex}.warc")
                        out, size = system.open_output_stream(posixpath.join(folder, files[-1])), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages):
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                system.move(posixpath.join(base, self.stage, f), posixpath.join(base, f))
        self._drop(system, base)

    def abort(self, messages):
        system, base = _filesystem(self.path)
        self._drop(system, base)

    def _drop(self, system, base):
        stage = posixpath.join(base, self.stage)
        if system.get_file_info(stage).type == pafs.FileType.Directory:
            system.delete_dir(stage)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)`` and ``df.write.format("warc").mode("append")``.

    Columns are those of ``SCHEMA``. With ``payload`` false that column is null throughout and no payload is read.
    A revisit's payload is null; ``refers_to`` names the record that holds it.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records to write, one per page: of equal payloads that with the smallest id is the response, others revisit it.

    A null html is an empty payload; empty payloads are equal to each other. Rows that repeat the smallest id are all
    responses. A page without an id is a revisit unless no page with its payload has one; its record id ends in ``null``.
    Groups of equal payloads are found by digest: minima are combined map-side and joined back, never gathered.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))).alias("sha")).groupBy("sha").agg(F.min("page_id").alias("first_id"))
    kind = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return rows.join(firsts, "sha").select(
        name("page_id").alias("record_id"), kind.alias("record_type"), "target_uri", base32("sha").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(kind == "revisit", name("first_id")).alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"), "payload")


def base32(sha: str) -> F.Column:
    """Base 32 of 20 bytes given in hex: eight characters for every five bytes."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for block in range(4):
        n = F.conv(F.substring(sha, 10 * block + 1, 10), 16, 10).cast("long")
        out += [F.substring(alphabet, (F.shiftright(n, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)
