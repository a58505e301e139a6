"""Recorder clocks and small numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.params import ANSWERS_PER_CHECK, SECONDS_PER_ANSWER, TIME_BANDS

# --- fixed values: file-name patterns ---
DATED = r"(?:^|[^0-9])([0-9]{8})[_\-T]([0-9]{6})(?:[^0-9]|$)"
HEX_EPOCH = r"^[0-9A-Fa-f]{8}$"
AUDIO_SUFFIX = r"(?i)\.(wav|flac|mp3|ogg|aiff?|m4a)$"


def parse_timestamp(stem: Column) -> Column:
    """ISO text: recorder-local from date_time names, UTC ('Z') from 8-hex epoch names in 2010..2040, else ''."""
    parts = F.concat(F.regexp_extract(stem, DATED, 1), F.regexp_extract(stem, DATED, 2))
    local = F.try_to_timestamp(F.when(parts != "", parts), F.lit("yyyyMMddHHmmss"))
    epoch = F.timestamp_seconds(F.conv(F.when(stem.rlike(HEX_EPOCH), stem), 16, 10).cast("long"))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return F.coalesce(F.date_format(local, iso),
                      F.when(F.year(epoch).between(2010, 2040), F.concat(F.date_format(epoch, iso), F.lit("Z"))), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.trim(path), r"([^\\/]*)$", 1), AUDIO_SUFFIX, "")


def recording_id_for(rel_path: Column) -> Column:
    """The path without its suffix, folders folded in."""
    return F.replace(F.regexp_replace(rel_path, r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(F.replace(F.when(text != "", text), F.lit("Z"), F.lit("")))


def birdnet_week(text: Column) -> Column:
    """A 48-week calendar: four quarters per month; NULL when the time is unknown."""
    t = iso_time(text)
    return (F.month(t) - 1) * 4 + F.least(F.lit(4), F.floor((F.dayofmonth(t) - 1) / 7) + 1)


def time_band(start_time: Column, offset_s: Column) -> Column:
    """Night, dawn, day or dusk of a moment in a recording; wraps midnight."""
    t = iso_time(start_time)
    h = F.pmod(F.hour(t) + (F.minute(t) * 60 + F.second(t) + offset_s) / 3600, F.lit(24.0))
    out = F.when(h.isNull(), F.lit("time unknown"))
    for name, lo, hi in TIME_BANDS:
        out = out.when((h >= lo) & (h < hi) if lo < hi else (h >= lo) | (h < hi), name)
    return out.otherwise("time unknown")


def stratum(site: Column, start_time: Column, offset_s: Column) -> Column:
    return F.concat(F.when(site != "", site).otherwise("no site"), F.lit(" · "), time_band(start_time, offset_s))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def units_for_margin(margin: Column, p: float = 0.8, z: float = 1.96) -> Column:
    return F.ceil(F.lit(z * z * p * (1 - p)) / (margin * margin))


def project(width: Column, n: Column, target: Column) -> tuple[Column, Column]:
    """How many units bring an interval of ``width`` (from ``n``) to ``target``: (low, high), NULL where undefined."""
    ok = (width > 0) & (n > 0) & (target > 0)
    r = F.try_divide(width, target)
    m = n * r * r
    return (F.when(ok, F.greatest(n.cast("long"), F.ceil(m * 0.85))), F.when(ok, F.greatest(n.cast("long"), F.ceil(m * 1.3))))


def volunteer_hours(checks: Column) -> tuple[Column, Column]:
    lo, hi = ANSWERS_PER_CHECK
    return checks * (lo * SECONDS_PER_ANSWER) / 3600, checks * (hi * SECONDS_PER_ANSWER) / 3600
