"""Species names as column expressions and small reference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: name patterns ---
SPECIES_PATTERN = r"^[A-Z][a-z]+ [a-z\-]+( [a-z\-]+)?$"
GUIDE_PATTERN = r"^[A-Z][a-z-]+ [a-z-]+"
EBIRD_PATTERN = r"^[a-z]{4,6}\d?$"
TIER_LABELS = {0: "listed", 1: "regular", 2: "vagrant", 3: "implausible"}


def normalise_key(name: Column) -> Column:
    """Trim, collapse spaces, Genus lower rest."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substr(flat, F.lit(2)))


def is_species(key: Column) -> Column:
    return key.rlike(SPECIES_PATTERN)


def guide_species(key: Column) -> Column:
    return key.rlike(GUIDE_PATTERN)


def genus(key: Column) -> Column:
    return F.substring_index(key, " ", 1)


def xc_species_url(key: Column) -> Column:
    return F.concat(F.lit("https://xeno-canto.org/species/"), F.replace(key, F.lit(" "), F.lit("-")))


def display_name(key: Column, common: Column) -> Column:
    return F.coalesce(F.when(common != "", common), F.replace(key, F.lit("_"), F.lit(" ")))


def tier_label(tier: Column) -> Column:
    t = F.coalesce(tier, F.lit(3))
    out = F.lit(TIER_LABELS[3])
    for k in (0, 1, 2):
        out = F.when(t == k, TIER_LABELS[k]).otherwise(out)
    return out


def scientific_part(label: Column, split_common: Column) -> Column:
    """The part before the first underscore for models whose labels carry a common name."""
    return F.when(split_common, F.substring_index(label, "_", 1)).otherwise(label)


def map_codes(labels: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) codes; nothing is dropped silently. The canonical table is one row per class."""
    c = canonical.where(F.coalesce("ebird_code", F.lit("")) != "").select(F.col("ebird_code").alias("code"), "species_key")
    return labels.join(c, "code"), labels.join(c, "code", "left_anti")


def map_scientific_names(labels: DataFrame, canonical: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``labels``: (label, split_common). Without a canonical table every parseable name defines a key."""
    d = labels.withColumn("species_key", normalise_key(scientific_part(F.col("label"), F.col("split_common"))))
    bad = F.col("species_key") == ""
    if canonical is None:
        return d.where(~bad), d.where(bad).select("label")
    known = canonical.select("species_key").distinct()
    return d.where(~bad).join(known, "species_key", "left_semi"), d.join(known, "species_key", "left_anti").select("label")


def vocabulary_collisions(mapped: DataFrame) -> DataFrame:
    """Keys that two labels fold to: an error, since score columns would misalign."""
    return mapped.groupBy("species_key").agg(F.count(F.lit(1)).alias("labels"), F.min("label").alias("first_label")).where(
        F.col("labels") > 1)


def species_lookup(names: DataFrame, codes: DataFrame) -> DataFrame:
    """What an imported file may call a species: key, common name (any case) or code; names win over codes."""
    rows = names.select(F.lower("species_key").alias("name"), F.lit(0).alias("p"), "species_key").unionByName(
        names.where(F.coalesce("common_name", F.lit("")) != "").select(
            F.lower("common_name").alias("name"), F.lit(1).alias("p"), "species_key")).unionByName(
        codes.select(F.lower("code").alias("name"), F.lit(2).alias("p"), "species_key"))
    return rows.groupBy("name").agg(F.min_by("species_key", F.struct("p", "species_key")).alias("species_key"))


def looks_like_codes(names: DataFrame) -> DataFrame:
    """At least 80% shaped like eBird codes."""
    return names.agg(F.coalesce(F.avg(F.trim("name").rlike(EBIRD_PATTERN).cast("int")) >= 0.8, F.lit(False)).alias("codes"))


def merge_common_names(entries: DataFrame) -> DataFrame:
    """(source, species_key, common_name) -> one name per species: the richest source wins, the rest fill gaps."""
    size = entries.groupBy("source").agg(F.count_distinct("species_key").alias("size"))
    return entries.join(size, "source").groupBy("species_key").agg(
        F.min_by("common_name", F.struct((-F.col("size")).alias("r"), "source", "common_name")).alias("common_name"))


def common_name_index(entries: DataFrame) -> DataFrame:
    """Only binomials keep a label-file name; event classes that merely split on an underscore do not."""
    return merge_common_names(entries).where(F.instr("species_key", " ") > 0)


def profile_first(profile_names: DataFrame, label_names: DataFrame) -> DataFrame:
    """The profile's common names over any label file's."""
    p = profile_names.where(F.coalesce("common_name", F.lit("")) != "").select("species_key", F.col("common_name").alias("_p"))
    return label_names.join(p, "species_key", "full_outer").select(
        "species_key", F.coalesce("_p", "common_name").alias("common_name"))


def tiers(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Add ``tier``; absent species are tier 3."""
    return df.join(profile.select("species_key", "tier"), "species_key", "left").withColumn("tier", F.coalesce("tier", F.lit(3)))


def suggest_profile(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The smallest area that holds each point (lat, lon), or NULL. ``boxes``: one row per profile.

    Points and areas meet on whole-degree latitude cells, so no point is compared with every profile.
    """
    b = boxes.withColumn("cell", F.explode(F.sequence(F.floor("min_lat"), F.floor("max_lat"))))
    area = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    hit = points.withColumn("cell", F.floor("lat")).join(b, "cell").where(
        F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    best = hit.groupBy("recording_id").agg(F.min_by("profile", F.struct(area, F.col("profile"))).alias("profile"))
    return points.join(best, "recording_id", "left")


def unknown_species(profile: DataFrame, canonical: DataFrame) -> DataFrame:
    return profile.select("species_key").join(canonical.select("species_key").distinct(), "species_key", "left_anti")


def plausible_keys(profile: DataFrame, max_tier: int = 2) -> DataFrame:
    return profile.where(F.col("tier") <= max_tier).select("species_key")

