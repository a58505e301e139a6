"""The domain frames (recordings, boxes, runs, aligned frames, ...) derived from the given tables.

Everything is computed from the whole tables with built-in functions; integer arithmetic comes
first so that any engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators.align import WIN, dense_scores, labelled_windows
from chorale.plans.registry import cte
from chorale.session import cut, spread

# --- fixed values: the label space of the fixtures (name, index in the vocabulary) ---
SPECIES = ("Catharus guttatus", "Catharus ustulatus", "Corvus corax", "Engine", "Poecile gambeli",
           "Setophaga petechia", "Sitta canadensis", "Strix nebulosa", "Turdus merula", "Turdus migratorius")
BY_EVENT = {"view": ("Turdus migratorius", "Turdus merula"), "click": ("Catharus guttatus", "Catharus ustulatus"),
            "purchase": ("Poecile gambeli", "Setophaga petechia"), "signup": ("Strix nebulosa", "Corvus corax"),
            "error": ("Engine", "Sitta canadensis")}
DURATION_S = 2592000.0
CHUNK_S = 43200.0
RUNS = {"runA": (21600.0, 7919), "runB": (32400.0, 104729)}


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A derived frame that a project keeps as a table (aligned frame, index, evidence): written once per session
    to the cluster's shared folder, so later plans start from a scan."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        _STORED[key] = cut(build())
    return _STORED[key]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def species(spark: SparkSession, d: str) -> DataFrame:
    """species_key, idx, tier (NULL: not in the profile), occ, theta (NULL: no operating point).

    The names come from the events themselves, so the frame is as large as the label space. It is stored, so that the
    planner knows its size and sends it to large frames rather than these to it."""
    names = stored(spark, d, "names", lambda: events(spark, d).select("species_key").distinct())
    idx = F.element_at(F.create_map(*[x for i, s in enumerate(SPECIES) for x in (F.lit(s), F.lit(i))]),
                       F.col("species_key"))
    return names.select(
        "species_key", idx.alias("idx"), F.when(idx < 9, idx % 4).alias("tier"), (idx / 10.0).alias("occ"),
        F.when(idx != 6, (idx * 5 + 30) / 100.0).alias("theta"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events with their place, second and species. They are dealt by row before anything is read off them, and stored: a
    file of one row group is read by one task, which would else make all that follows."""
    def build():
        e = table(spark, d, "events")
        name = F.lit(None).cast("string")
        for kind, (even, odd) in BY_EVENT.items():
            name = F.when(F.col("event_type") == kind,
                          F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)).otherwise(name)
        r = F.floor(F.col("user_id") / 5)
        raw = spread(e.select("event_id", "ts", "user_id", "event_type", "props"), "event_id", rows=e.count())
        return raw.select(
            "event_id", r.alias("r"), F.concat(F.lit("r"), r.cast("string")).alias("recording_id"),
            F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000000").alias("sec"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), name.alias("species_key"))
    return stored(spark, d, "events", build)


def recordings(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r")
    return events(spark, d).select("r", "recording_id").distinct().select(
        "recording_id", F.concat(F.lit("site"), (r % 5).cast("string"), F.lit("/"), F.col("recording_id"),
                                 F.lit(".wav")).alias("path"),
        F.lit(DURATION_S).alias("duration_s"), F.lit(32000).alias("sample_rate"), F.lit(1).alias("channels"),
        F.lit("2024-01-01T00:00:00").alias("start_time"),
        F.concat(F.lit("site"), (r % 5).cast("string")).alias("site"), (r % 90).cast("double").alias("lat"),
        (-r).cast("double").alias("lon"), (r % 3 != 0).alias("labelled"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the events with k >= 50, with a box id."""
    return events(spark, d).where("k >= 50").select(
        "recording_id", F.col("sec").cast("double").alias("start_s"),
        (F.col("sec") + 60 + F.col("k") * 300).cast("double").alias("end_s"),
        (F.lit(500.0) + F.col("k") * 10).alias("low_hz"), (F.lit(2500.0) + F.col("k") * 10).alias("high_hz"),
        "species_key", F.col("event_id").cast("string").alias("box_id"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, recording_id, start_s, end_s, species_key, score float): the best score per window and species. Nearly every
    row is a group of its own, so rows meet their window's task first, and no task adds up what it happens to read."""
    def build():
        e = events(spark, d)
        runs = F.array(*[F.struct(F.lit(n).alias("run_id"), F.lit(w).alias("w"), F.lit(m).alias("m"))
                         for n, (w, m) in RUNS.items()])
        x = e.withColumn("run", F.explode(runs)).select("*", "run.*")
        raw = (F.col("event_id") * F.col("m")) % 1000 + F.when(F.col("k") >= 50, 400).otherwise(0)
        start = F.floor(F.col("sec") / F.col("w")) * F.col("w")
        rows = x.select(
            "run_id", "recording_id", start.cast("double").alias("start_s"),
            (start + F.col("w")).cast("double").alias("end_s"), "species_key",
            F.least(raw / 1000.0, F.lit(1.0)).cast("float").alias("score"))
        return spread(rows, *WIN, rows=len(RUNS) * e.count()).groupBy(*WIN, "end_s", "species_key").agg(F.max("score").alias("score"))
    return stored(spark, d, "scored", build)


def score_windows(spark: SparkSession, d: str) -> DataFrame:
    """The score matrix as rows: every window of both grids with an array over the vocabulary."""
    idx = F.element_at(F.create_map(*[x for i, s in enumerate(SPECIES) for x in (F.lit(s), F.lit(i))]),
                       F.col("species_key"))
    got = scored(spark, d).groupBy("run_id", "recording_id", "start_s").agg(
        F.map_from_entries(F.collect_list(F.struct(idx, "score"))).alias("m"))  # one entry per vocabulary class
    grids = F.array(*[F.struct(F.lit(n).alias("run_id"), F.lit(w).alias("w"),
                               F.lit(int((DURATION_S - w) // w) + 1).alias("n")) for n, (w, _) in RUNS.items()])
    wins = spread(recordings(spark, d).select("recording_id"), "recording_id").select("recording_id", F.explode(grids).alias("g")).select(
        "recording_id", "g.run_id", "g.w", F.explode(F.sequence(F.lit(0), F.col("g.n") - 1)).alias("i"))
    wins = wins.select("run_id", "recording_id", (F.col("i") * F.col("w")).alias("start_s"),
                       ((F.col("i") + 1) * F.col("w")).alias("end_s"))
    zero = F.lit(0.0).cast("float")
    return wins.join(got, ["run_id", "recording_id", "start_s"], "left").select(
        "run_id", "recording_id", "start_s", "end_s",
        F.transform(F.sequence(F.lit(0), F.lit(len(SPECIES) - 1)),
                    lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("scores"))


def windows_with_labels(spark: SparkSession, d: str) -> DataFrame:
    """The score matrix with the set of species that are true of each window, on each run's own grid."""
    return stored(spark, d, "windows", lambda: labelled_windows(score_windows(spark, d), annotations(spark, d), bucket_s=21600.0))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """The dense (run, window, species) frame with truth, on each run's own grid."""
    return stored(spark, d, "aligned", lambda: dense_scores(windows_with_labels(spark, d), list(SPECIES), list(SPECIES), "labels"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    """The index in the DETECTIONS shape (all scored classes), with replayed occurrence and judge columns."""
    from chorale.operators.index import apply_occurrence, rank_windows
    def build():
        occ = species(spark, d).select("species_key", F.col("occ").cast("float").alias("occ"))
        return apply_occurrence(rank_windows(scored(spark, d)), occ, ["species_key"], 0.3).withColumn(
            "implausible", F.col("suppressed"))
    return stored(spark, d, "detections", build)


def thresholded(spark: SparkSession, d: str) -> DataFrame:
    """Detections with the fixture's theta per species attached (``above``)."""
    from chorale.operators.thresholds import attach
    th = species(spark, d).select("species_key", "theta", F.lit("rule").alias("source"))
    return attach(detections(spark, d), th)


def label_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sign-off chunks: (r + 3*i) % 5 != 0 closed, and all of every sixth recording, by one of three labellers, at a
    recoverable time."""
    ch = spread(recordings(spark, d), "recording_id").select(
        "recording_id", "site", "start_time", "duration_s",
        F.explode(F.sequence(F.lit(0), F.lit(int(DURATION_S // CHUNK_S) - 1))).alias("i"))
    r = F.expr("substring(recording_id, 2)").cast("long")
    i = F.col("i")
    closed = ((r + 3 * i) % 5 != 0) | (r % 6 == 0)
    at = (r * 60 + i) * 240 + F.floor((r * 60 + i) / 7) * 1800
    return ch.select(
        "recording_id", (i * CHUNK_S).alias("start_s"), ((i + 1) * CHUNK_S).alias("end_s"), "site", "start_time",
        F.when(closed, "closed").otherwise("open").alias("state"),
        F.when(closed, F.concat(F.lit("p"), (i % 3).cast("string"))).otherwise("").alias("closed_by"),
        F.when(closed, at).alias("closed_sec"))


def label_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes as a label set: every 11th is an unknown bird, every 4th was drawn with suggestions."""
    e = F.col("box_id").cast("long")
    return annotations(spark, d).withColumn(
        "species_key", F.when(e % 11 == 0, "unknown bird").otherwise(F.col("species_key"))).withColumn(
        "assisted", e % 4 == 0).withColumn("labeller", F.concat(F.lit("p"), (e % 3).cast("string")))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """A drawn sample: chunks with (5*r + i) % 4 = 0, ordered by (i, r)."""
    r = F.expr("substring(recording_id, 2)").cast("long")
    i = F.floor(F.col("start_s") / CHUNK_S)
    return label_chunks(spark, d).where((5 * r + i) % 4 == 0).select(
        "recording_id", "start_s", "end_s", (i * 100000 + r).alias("order"), F.lit("s").alias("stratum"),
        F.lit(False).alias("whole"))


def checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers on run A detections: event-derived verdicts, yes where the window is truly positive."""
    al = aligned(spark, d).where((F.col("run_id") == "runA") & (F.col("score") > 0))
    r = F.expr("substring(recording_id, 2)").cast("long")
    w = (F.col("start_s") / 21600).cast("long")
    h = (r * 31 + w * 17) % 7
    return al.where(h < 3).select(
        "recording_id", "start_s", "species_key",
        F.when(h == 2, F.when(w % 2 == 0, "unsure").otherwise("no"))
        .when(F.col("y_true") == 1, "yes").otherwise("no").alias("verdict"),
        (F.col("y_true") == 1).alias("reference"), F.lit("p1").alias("labeller"),
        F.format_string("2024-02-01T%05d", w).alias("at"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    from chorale.operators.calibrate import candidate_pool
    return candidate_pool(detections(spark, d).where("run_id = 'runA'"), "other")


def line_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The aligned frame at lineitem volume: supplier = recording, brand = species."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    x = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    raw = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000 * 6 + y * 4000
    start = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 3).cast("double")
    return x.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("recording_id"), start.alias("start_s"),
        F.col("p_brand").alias("species_key"), y.alias("y_true"), (raw / 10000.0).cast("float").alias("score"),
    ).groupBy("recording_id", "start_s", "species_key").agg(
        F.max("y_true").alias("y_true"), F.max("score").alias("score")).withColumn("end_s", F.col("start_s") + 3)


def document_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Real labels: source = recording, language = species, quality = truth, length = score."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select(
        F.col("source").alias("recording_id"), F.col("doc_id").cast("double").alias("start_s"),
        (F.col("doc_id") + 1).cast("double").alias("end_s"), F.col("lang").alias("species_key"),
        F.col("quality").alias("y_true"),
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).cast("float").alias("score"))


# ---------------------------------------------------------------- the same frames in SQL
_case = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN event_id % 2 = 0 THEN '{a}' ELSE '{b}' END" for k, (a, b) in BY_EVENT.items()) + " END"
cte("e_ev", f"""SELECT event_id, user_id // 5 AS r, 'r' || CAST(user_id // 5 AS VARCHAR) AS recording_id,
 CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS BIGINT) AS sec,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, {_case} AS species_key FROM events""")
cte("spp", "SELECT *, CASE WHEN idx < 9 THEN idx % 4 END AS tier, idx / 10.0::DOUBLE AS occ, "
    "CASE WHEN idx <> 6 THEN (idx * 5 + 30) / 100.0::DOUBLE END AS theta FROM (VALUES "
    + ", ".join(f"('{s}', {i})" for i, s in enumerate(SPECIES)) + ") t(species_key, idx)")
cte("e_rec", """SELECT DISTINCT r, recording_id, 'site' || (r % 5) || '/' || recording_id || '.wav' AS path,
 2592000.0::DOUBLE AS duration_s, 'site' || (r % 5) AS site, '2024-01-01T00:00:00' AS start_time,
 (r % 90)::DOUBLE AS lat, (-r)::DOUBLE AS lon, r % 3 <> 0 AS labelled FROM e_ev""")
cte("e_ann", """SELECT recording_id, sec::DOUBLE AS start_s, (sec + 60 + k * 300)::DOUBLE AS end_s,
 500.0::DOUBLE + k * 10 AS low_hz, 2500.0::DOUBLE + k * 10 AS high_hz, species_key,
 CAST(event_id AS VARCHAR) AS box_id FROM e_ev WHERE k >= 50""")
cte("runs", "SELECT * FROM (VALUES ('runA', 21600, 7919), ('runB', 32400, 104729)) t(run_id, w, m)")
cte("e_score", """SELECT run_id, recording_id, (sec // w * w)::DOUBLE AS start_s, (sec // w * w + w)::DOUBLE AS end_s,
 species_key, max(CAST(CAST(least(((event_id * m) % 1000 + CASE WHEN k >= 50 THEN 400 ELSE 0 END)
   / 1000.0::DOUBLE, 1.0) AS FLOAT) AS DOUBLE)) AS score
 FROM e_ev, runs GROUP BY 1, 2, 3, 4, 5""")
cte("e_win", """SELECT run_id, recording_id, (i * w)::DOUBLE AS start_s, ((i + 1) * w)::DOUBLE AS end_s
 FROM e_rec, runs, (SELECT unnest(range(0, 200)) AS i) WHERE i < 2592000 // w""")
cte("e_al", """SELECT w.run_id, w.recording_id, w.start_s, w.end_s, s.species_key, coalesce(x.score, 0.0) AS score,
 CASE WHEN EXISTS (SELECT 1 FROM e_ann a WHERE a.recording_id = w.recording_id AND a.species_key = s.species_key
   AND least(a.end_s, w.end_s) - greatest(a.start_s, w.start_s) > 0
   AND least(a.end_s, w.end_s) - greatest(a.start_s, w.start_s) >= least(0.5, a.end_s - a.start_s) - 1e-9)
   THEN 1 ELSE 0 END AS y_true
 FROM e_win w CROSS JOIN spp s LEFT JOIN e_score x ON x.run_id = w.run_id AND x.recording_id = w.recording_id
   AND x.start_s = w.start_s AND x.species_key = s.species_key""")
cte("e_det", """SELECT x.*, s.occ, s.occ < 0.3 AS suppressed, s.occ < 0.3 AS implausible, s.idx, s.tier, s.theta,
 coalesce(x.score >= s.theta, false) AS above,
 row_number() OVER (PARTITION BY run_id, recording_id, start_s ORDER BY score DESC, x.species_key) AS rank
 FROM e_score x JOIN spp s USING (species_key)""")
cte("chunks", """SELECT recording_id, (i * 43200)::DOUBLE AS start_s, ((i + 1) * 43200)::DOUBLE AS end_s, r, i, site,
 CASE WHEN (r + 3 * i) % 5 <> 0 OR r % 6 = 0 THEN 'closed' ELSE 'open' END AS state,
 CASE WHEN (r + 3 * i) % 5 <> 0 OR r % 6 = 0 THEN 'p' || (i % 3) ELSE '' END AS closed_by,
 CASE WHEN (r + 3 * i) % 5 <> 0 OR r % 6 = 0 THEN (r * 60 + i) * 240 + (r * 60 + i) // 7 * 1800 END AS closed_sec
 FROM e_rec, (SELECT unnest(range(0, 60)) AS i)""")
cte("boxes", """SELECT recording_id, start_s, end_s, low_hz, high_hz,
 CASE WHEN CAST(box_id AS BIGINT) % 11 = 0 THEN 'unknown bird' ELSE species_key END AS species_key, box_id,
 CAST(box_id AS BIGINT) % 4 = 0 AS assisted, 'p' || (CAST(box_id AS BIGINT) % 3) AS labeller FROM e_ann""")
cte("sampled", "SELECT recording_id, start_s, end_s, i * 100000 + r AS ord FROM chunks WHERE (5 * r + i) % 4 = 0")
cte("checks", """SELECT recording_id, start_s, species_key, CASE WHEN h = 2 THEN CASE WHEN w % 2 = 0 THEN 'unsure' ELSE
 'no' END WHEN y_true = 1 THEN 'yes' ELSE 'no' END AS verdict, w FROM (SELECT *, CAST(start_s / 21600 AS BIGINT) AS w,
 (CAST(substr(recording_id, 2) AS BIGINT) * 31 + CAST(start_s / 21600 AS BIGINT) * 17) % 7 AS h
 FROM e_al WHERE run_id = 'runA' AND score > 0) WHERE h < 3""")
cte("pool", """SELECT recording_id, start_s, end_s, species_key, score, rank, occ FROM e_det
 WHERE run_id = 'runA' AND rank <= 3""")
cte("l_al", """SELECT 's' || l_suppkey AS recording_id, ((l_orderkey * 8 + l_linenumber) * 3)::DOUBLE AS start_s,
 p_brand AS species_key, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y_true,
 max(CAST(CAST(((l_orderkey * 31 + l_linenumber * 17) % 1000 * 6 + CASE WHEN l_returnflag = 'R' THEN 4000 ELSE 0 END)
   / 10000.0::DOUBLE AS FLOAT) AS DOUBLE)) AS score
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
cte("d_al", """SELECT source AS recording_id, doc_id::DOUBLE AS start_s, lang AS species_key, quality AS y_true,
 CAST(CAST(n_chars / (n_chars + 2000.0::DOUBLE) AS FLOAT) AS DOUBLE) AS score
 FROM documents JOIN labels USING (doc_id)""")


def _curve_sql(src: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}score AS theta, p AS dp, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp,
 sum(p) OVER ({part}) AS n_pos, sum(n) OVER ({part}) AS n_all,
 sum(p) OVER w / sum(n) OVER w AS precision,
 CASE WHEN sum(p) OVER ({part}) > 0 THEN sum(p) OVER w / sum(p) OVER ({part}) END AS recall
 FROM (SELECT {lead}score, sum(y_true)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {src} GROUP BY {lead}score)
 WINDOW w AS ({part} ORDER BY score DESC)"""


cte("l_curve", _curve_sql("l_al", "species_key"))
cte("l_micro", _curve_sql("l_al", ""))
cte("d_curve", _curve_sql("d_al", "species_key"))
cte("e_curve", _curve_sql("e_al", "run_id, species_key"))
cte("e_micro", _curve_sql("e_al", "run_id"))
