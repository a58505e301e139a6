"""Annotation files and species tables as Spark reads: exchange CSV, selection tables, label tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions.clock import file_stem
from chorale.functions.names import normalise_key

# --- fixed values: exchange column names ---
EXCHANGE = {"recording_id": "Filename", "start_s": "Start Time (s)", "end_s": "End Time (s)", "low_hz": "Low Freq (Hz)",
            "high_hz": "High Freq (Hz)", "species_key": "Species"}
SPECIES_COLUMNS = ("Species", "Species eBird Code", "Common Name")
SELECTION_SPECIES = ("Species", "Annotation", "Common Name", "Label")


def canonical_species(raw: DataFrame) -> DataFrame:
    """A dataset's species list in canonical columns."""
    return raw.select(normalise_key(F.col("Scientific Name")).alias("species_key"), F.col("Common Name").alias("common_name"),
                      F.col("Species eBird Code").alias("ebird_code"))


def _num(name: str, have: list[str]):
    return F.expr(f"try_cast(`{name}` as double)") if name in have else F.lit(None).cast("double")


def read_exchange(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_s, end_s, low_hz, high_hz, name) of an exchange CSV."""
    df = spark.read.option("header", True).csv(path)
    sp = next(c for c in SPECIES_COLUMNS if c in df.columns)
    return df.select(F.col("Filename").alias("file"), *[_num(EXCHANGE[c], df.columns).alias(c) for c in ("start_s", "end_s", "low_hz", "high_hz")],
                     F.col(f"`{sp}`").alias("name"))


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated selection table; the recording is named in a column or by the file."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    sp = next((c for c in SELECTION_SPECIES if c in df.columns), None)
    if sp is None:
        raise ValueError("the table has no Species / Annotation column")
    named = next((c for c in ("Begin File", "Begin Path") if c in df.columns), None)
    f = F.regexp_extract(F.col(f"`{named}`"), r"([^\\/]*)$", 1) if named else F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return df.select(f.alias("file"), _num("Begin Time (s)", df.columns).alias("start_s"), _num("End Time (s)", df.columns).alias("end_s"),
                     _num("Low Freq (Hz)", df.columns).alias("low_hz"), _num("High Freq (Hz)", df.columns).alias("high_hz"), F.col(f"`{sp}`").alias("name"))


def read_label_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Label tracks (start, end, label by tabs), with frequency lines continuing the row before them.

    A track is one file, read whole; its lines keep their number, and a continuation is the next line.
    """
    t = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("file"), "value")
    lines = t.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    p = F.split("line", "\t")
    d = lines.select("file", "i", p.alias("p"), F.lead(p).over(Window.partitionBy("file").orderBy("i")).alias("nx"))
    more = F.try_element_at("nx", F.lit(1)) == "\\"
    num = lambda a, i: F.try_element_at(a, F.lit(i)).try_cast("double")
    return d.where(F.try_element_at("p", F.lit(1)) != "\\").select(
        "file", num("p", 1).alias("start_s"), num("p", 2).alias("end_s"), F.when(more, num("nx", 2)).alias("low_hz"),
        F.when(more, num("nx", 3)).alias("high_hz"), F.try_element_at("p", F.lit(3)).alias("name"))


READERS = {"exchange": read_exchange, "selections": read_selections, "tracks": read_label_tracks}


def recording_names(recordings: DataFrame) -> DataFrame:
    """(k, recording_id): what a file name stands for, one row per name: the recording with that id, else the only one
    with that file stem. A stem of several recordings stands for none (null), so that it is reported, never guessed."""
    names = recordings.select("recording_id", F.col("recording_id").alias("k"), F.lit(True).alias("own")).union(
        recordings.select("recording_id", file_stem(F.col("path")).alias("k"), F.lit(False).alias("own")))
    stem = F.when(~F.col("own"), F.col("recording_id"))
    found = names.groupBy("k").agg(F.max(F.when(F.col("own"), F.col("recording_id"))).alias("a"), F.min(stem).alias("b"), F.max(stem).alias("c"))
    return found.select("k", F.coalesce("a", F.when(F.col("b") == F.col("c"), F.col("b"))).alias("recording_id"))


def resolve_boxes(rows: DataFrame, recordings: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, unmapped names, unknown files). Nothing is dropped silently; zero-length boxes are."""
    d = rows.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn("_stem", file_stem(F.col("file"))).withColumn(
        "_head", F.substring_index(F.col("_stem"), ".", 1))
    by = recording_names(recordings)
    d = d.join(lookup.select(F.col("name").alias("_l"), "species_key"), F.lower("name") == F.col("_l"), "left").drop("_l")
    unmapped = d.where(F.col("species_key").isNull()).select("name").distinct()
    ok = d.where(F.col("species_key").isNotNull())
    ok = ok.join(by.select(F.col("k").alias("_stem"), F.col("recording_id").alias("_r1")), "_stem", "left").join(
        by.select(F.col("k").alias("_head"), F.col("recording_id").alias("_r2")), "_head", "left").withColumn("recording_id", F.coalesce("_r1", "_r2"))
    unknown = ok.where(F.col("recording_id").isNull()).select("file").distinct()
    boxes = ok.where(F.col("recording_id").isNotNull() & (F.col("end_s") > F.col("start_s"))).select(
        "recording_id", "start_s", "end_s", "low_hz", "high_hz", "species_key")
    return boxes, unmapped, unknown


def ingest_annotations(raw: DataFrame, canonical: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exchange rows with codes: (annotations, unmapped codes, orphan boxes); both reports must be empty."""
    lk = canonical.where(F.coalesce("ebird_code", F.lit("")) != "").select(F.col("ebird_code").alias("name"), "species_key")
    unmapped = raw.join(lk, "name", "left_anti").select("name").distinct()
    rows = raw.join(lk, "name").where(F.col("end_s") > F.col("start_s")).withColumn("recording_id", file_stem(F.col("file")))
    orphans = rows.join(recordings.select("recording_id"), "recording_id", "left_anti").select("recording_id").distinct()
    return rows.select("recording_id", "start_s", "end_s", "low_hz", "high_hz", "species_key"), unmapped, orphans


def export_boxes(boxes: DataFrame, chunks: DataFrame, recordings: DataFrame, names: DataFrame, chunk_s: float = 60.0) -> DataFrame:
    """Boxes in exchange columns with provenance and whether their chunk is closed."""
    closed = chunks.where("state = 'closed'").select("recording_id", F.col("start_s").alias("_chunk"), F.lit(True).alias("_c"))
    files = recordings.select("recording_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("_file"))
    d = boxes.withColumn("_chunk", F.floor(F.col("start_s") / chunk_s) * chunk_s).join(closed, ["recording_id", "_chunk"], "left").join(
        files, "recording_id", "left").join(names.select("species_key", "common_name"), "species_key", "left")
    d = d.withColumn("recording_id", F.coalesce("_file", "recording_id"))
    return d.select(*[F.col(c).alias(n) for c, n in EXCHANGE.items()], F.coalesce("common_name", "species_key").alias("Common Name"),
                    F.col("labeller").alias("Labeller"), F.col("assisted").alias("Suggestions Viewed"), F.coalesce("_c", F.lit(False)).alias("Chunk Closed"))
