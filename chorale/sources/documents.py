"""Stored documents of a project: run manifests, label sets, threshold sets and setups, as numbered commits.

A commit is one small JSON file, ``heads/<kind>/n-<name>/<number>.json``. It appears whole and only if its number is
free, so of two writers that start from the same number one is refused (``StaleWrite``). Tables are Parquet folders of
their own, written by ordinary Spark jobs before the commit names them; a commit that leaves a table as it was names the
folder of the one before, so copies and published versions cost no bytes. Nothing is rewritten: what was published never
changes, and a deletion is a commit too. Files that are no commits are passed over.

The commit is a rename that refuses an existing target (HDFS and file systems like it) or a hard link (local folders).
Names are checked where people choose them and quoted where they do not. Empty store, unknown names: empty listings, and
``FileNotFoundError`` from ``load``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale import schemas
from chorale.operators.intervals import all_chunks

HEAD = T.StructType([T.StructField(name, kind) for kind, names in (
    (T.StringType(), "kind name author derived_from created updated body"), (T.LongType(), "number published versions"),
    (T.BooleanType(), "deleted"), (T.MapType(T.StringType(), T.StringType()), "tables")) for name in names.split()])
MANIFEST = T.StructType([*schemas.RUNS.fields, T.StructField("input_sr", T.LongType()), T.StructField("profile", T.StringType())])
LABEL_TABLES = {"boxes": schemas.BOXES, "chunks": schemas.CHUNKS, "sample": schemas.SAMPLE}
IMPORTED = "imported"


class StaleWrite(ValueError):
    """The document has changed since it was read."""


class FrozenVersion(ValueError):
    """A published version cannot change."""


def usable_name(name: str) -> bool:
    """Up to 64 letters, digits, ``-``, ``_`` and ``.``, a letter or digit first; not the name of the imported set."""
    return name != IMPORTED and re.fullmatch(r"[A-Za-z0-9][\w.-]{0,63}", name, re.ASCII) is not None


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


# ------------------------------------------------------------------ the log
def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, fs = _place(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False where it is. Readers never see a part of it."""
    target, fs = _place(spark, path)
    fs.mkdirs(target.getParent())
    draft, _ = _place(spark, f"{target.getParent()}/.{uuid.uuid4().hex}.draft")
    if fs.getScheme() == "file":
        here, there = (p.toUri().getPath() for p in (draft, target))
        try:
            with open(here, "x") as f:
                f.write(text)
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def _folder(part: str, kind: str, name: str) -> str:
    return f"{part}/{kind}/n-{quote(name, safe='')}"


def commits(spark: SparkSession, path: str, kind: str, name: str | None = None) -> DataFrame:
    """All commits of a kind, or of one name."""
    at = f"{path}/heads/{kind}" if name is None else f"{path}/{_folder('heads', kind, name)}"
    if not _there(spark, at):
        return schemas.empty(spark, HEAD)
    read = spark.read.schema(HEAD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at)
    return read.where(F.col("number").isNotNull() & (F.col("kind") == kind))


def current(log: DataFrame) -> DataFrame:
    """The last commit of each name that is not deleted."""
    return log.groupBy("name").agg(F.max_by(F.struct(*HEAD.names), "number").alias("h")).select("h.*").where("not deleted")


def versions(log: DataFrame) -> DataFrame:
    """(name, number, published, updated): the frozen versions, of names not deleted."""
    gone = log.where("deleted").groupBy("name").agg(F.max("number").alias("gone"))
    return log.where("published is not null").join(gone, "name", "left").where(
        F.col("gone").isNull() | (F.col("number") > F.col("gone"))).select("name", "number", "published", "updated")


@dataclass(frozen=True)
class Document:
    """A document as it was read."""

    spark: SparkSession
    path: str
    head: Row
    frozen: bool = False

    @property
    def body(self) -> dict:
        return json.loads(self.head.body)

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of it, empty where it has none; columns younger than the files are null, flags false."""
        if name not in self.head.tables:
            return schemas.empty(self.spark, schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{self.head.tables[name]}")
        flags = [f.name for f in schema if isinstance(f.dataType, T.BooleanType)]
        return df.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}) if flags else df


def _last(spark: SparkSession, path: str, kind: str, name: str) -> Row | None:
    return commits(spark, path, kind, name).orderBy(F.desc("number")).first()


def load(spark: SparkSession, path: str, kind: str, name: str, version: int | None = None) -> Document:
    """The working copy, or a published version of it."""
    last = _last(spark, path, kind, name)
    if last is None or last.deleted:
        raise FileNotFoundError(f"nothing named {name!r} among {kind}")
    if version is None:
        return Document(spark, path, last)
    log = commits(spark, path, kind, name)
    past = log.join(versions(log).where(F.col("published") == version).select("number"), "number", "left_semi").first()
    if past is None:
        raise FileNotFoundError(f"{name!r} among {kind} has no version {version}")
    return Document(spark, path, past, frozen=True)


def commit(spark: SparkSession, path: str, kind: str, name: str, before: Row | None, tables: dict[str, DataFrame] | None = None,
           body: dict | None = None, kept: dict[str, str] | None = None, publish: bool = False, deleted: bool = False,
           author: str = "", derived_from: str = "", at: str | None = None) -> Document:
    """The commit after ``before`` (None: the first); ``kept`` names tables that stay as they are."""
    old = before.asDict() if before is not None and not before.deleted else {}
    at = at or now()
    own = f"{_folder('data', kind, name)}/{uuid.uuid4().hex}"
    for t, df in (tables or {}).items():
        df.write.parquet(f"{path}/{own}/{t}")
    n_versions = (old.get("versions") or 0) + publish
    head = {"kind": kind, "name": name, "number": (before.number if before is not None else 0) + 1,
            "published": n_versions if publish else None, "versions": n_versions, "deleted": deleted,
            "author": author or old.get("author") or "", "derived_from": derived_from or old.get("derived_from") or "",
            "created": old.get("created") or at, "updated": at,
            "tables": {**(kept or {}), **{t: f"{own}/{t}" for t in tables or {}}},
            "body": json.dumps(body, sort_keys=True) if body is not None else old.get("body") or "{}"}
    if not _put_if_absent(spark, f"{path}/{_folder('heads', kind, name)}/{head['number']:012d}.json", json.dumps(head)):
        _drop(spark, f"{path}/{own}")
        raise StaleWrite(f"{name!r} among {kind} has changed since it was read")
    return Document(spark, path, Row(**head))


def put(spark: SparkSession, path: str, kind: str, name: str, body: dict, tables: dict[str, DataFrame] | None = None,
        author: str = "", at: str | None = None) -> Document:
    """Create a named document or replace it whole; its time of creation stays."""
    if not usable_name(name):
        raise ValueError(f"{name!r} cannot be a name: letters, digits, - _ . and not {IMPORTED!r}")
    return commit(spark, path, kind, name, _last(spark, path, kind, name), tables, body, author=author, at=at)


def delete(spark: SparkSession, path: str, kind: str, name: str) -> None:
    """Take a name out of the listings; nothing happens where it is not there."""
    last = _last(spark, path, kind, name)
    if last is not None and not last.deleted:
        commit(spark, path, kind, name, last, deleted=True)


def listed(log: DataFrame) -> DataFrame:
    """(name, created, updated, versions) by name, letter case aside."""
    return current(log).select("name", "created", "updated", "versions").orderBy(F.lower("name"), "name")


def superseded(log: DataFrame) -> DataFrame:
    """(folder) of tables that neither a working copy nor a published version of any name refers to; copies share folders,
    so ``log`` must hold all names of the kind."""
    of = lambda df: df.select(F.explode(F.map_values("tables")).alias("folder")).distinct()
    frozen = log.join(versions(log).select("name", "number"), ["name", "number"], "left_semi")
    return of(log).join(of(current(log)).union(of(frozen)), "folder", "left_anti")


def prune(spark: SparkSession, path: str, kind: str) -> int:
    """Remove superseded tables, one folder at a time; a second call after a failure does the rest."""
    n = 0
    for r in superseded(commits(spark, path, kind)).toLocalIterator():
        if _there(spark, f"{path}/{r.folder}"):
            _drop(spark, f"{path}/{r.folder}")
            n += 1
    return n


# ------------------------------------------------------------------ run manifests
def save_manifest(spark: SparkSession, path: str, manifest: dict) -> str:
    """Store what a run was executed with; the id and the UTC time are made where not given. A stored id is refused."""
    unknown = set(manifest) - set(MANIFEST.names)
    missing = {"model_name", "model_version", "window_s", "hop_s", "input_sr", "score_transform"} - set(manifest)
    if unknown or missing:
        raise schemas.SchemaError(f"manifest: unknown {sorted(unknown)}, missing {sorted(missing)}")
    m = {"geofilter": {}, "packages": {}, "profile": "", "dataset": "", **manifest}
    m["created_utc"] = m.get("created_utc") or now()
    m["run_id"] = m.get("run_id") or f"{m['model_name']}-{uuid.uuid4().hex[:8]}"
    try:
        commit(spark, path, "runs", m["run_id"], None, body=m, at=m["created_utc"])
    except StaleWrite as e:
        raise FileExistsError(f"run {m['run_id']!r} has a manifest") from e
    return m["run_id"]


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifests, newest first."""
    m = current(commits(spark, path, "runs")).select(F.from_json("body", MANIFEST).alias("m")).select("m.*")
    return m.orderBy(F.desc("created_utc"), "run_id")


# ------------------------------------------------------------------ label sets
def create_set(spark: SparkSession, path: str, dataset: str, name: str, author: str, derived_from: str = "",
               imported: tuple[DataFrame, DataFrame] | None = None, chunk_s: float = 60.0) -> Document:
    """A new working set: empty, a copy of another set's working copy, or of the imported (recordings, annotations), whose
    labelled recordings count as signed off."""
    if not usable_name(name):
        raise ValueError(f"{name!r} cannot be a name: letters, digits, - _ . and not {IMPORTED!r}")
    kind = label_kind(dataset)
    last = _last(spark, path, kind, name)
    if last is not None and not last.deleted:
        raise FileExistsError(f"label set {name!r} is there already")
    tables, kept = {}, {}
    if derived_from == IMPORTED:
        tables = imported_tables(*imported, chunk_s)
    elif derived_from:
        kept = load(spark, path, kind, derived_from).head.tables
    return commit(spark, path, kind, name, last, tables, {"dataset": dataset}, kept, author=author, derived_from=derived_from)


def label_kind(dataset: str) -> str:
    return f"labels-{quote(dataset, safe='')}"


def imported_tables(recordings: DataFrame, annotations: DataFrame, chunk_s: float = 60.0) -> dict[str, DataFrame]:
    """Boxes and closed chunks of annotations that came with the recordings."""
    boxes = annotations.select(
        *schemas.ANNOTATIONS.names, F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 12).alias("box_id"),
        F.lit(IMPORTED).alias("labeller"), F.lit("").alias("labelled_at"), F.lit(False).alias("assisted"))
    chunks = all_chunks(recordings.where("labelled"), chunk_s).select(
        "recording_id", "start_s", "end_s", F.lit("closed").alias("state"), F.lit(IMPORTED).alias("closed_by"),
        F.lit("").alias("closed_at"), F.lit("").alias("reopen_reason"))
    return {"boxes": boxes, "chunks": chunks}


def save_set(doc: Document, author: str = "", **tables: DataFrame) -> Document:
    """Write changed tables (boxes, chunks, sample) of a working copy; the rest stays as it was."""
    if doc.frozen:
        raise FrozenVersion(f"version {doc.head.published} of {doc.head.name!r} is published")
    unknown = set(tables) - set(LABEL_TABLES)
    if unknown:
        raise schemas.SchemaError(f"a label set has no table {sorted(unknown)}")
    if "boxes" in tables:
        schemas.validate(tables["boxes"].select(*schemas.ANNOTATIONS.names), "annotations")
    fit = {t: df.select(*[F.col(f.name).cast(f.dataType) for f in LABEL_TABLES[t]]) for t, df in tables.items()}
    kept = {t: p for t, p in doc.head.tables.items() if t not in fit}
    return commit(doc.spark, doc.path, doc.head.kind, doc.head.name, doc.head, fit, kept=kept, author=author)


def publish_set(doc: Document) -> Document:
    """Freeze the working copy as the next version; what refers to an earlier one keeps its meaning."""
    if doc.frozen:
        raise FrozenVersion(f"version {doc.head.published} of {doc.head.name!r} is published")
    return commit(doc.spark, doc.path, doc.head.kind, doc.head.name, doc.head, kept=doc.head.tables, publish=True)
