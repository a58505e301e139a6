"""Session settings for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "chorale", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_MADE: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a new one per session only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _MADE[app]


#: Rows that one task of ``spread`` takes where their number is known.
ROWS = 250_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """The frame dealt over four tasks a core, before each row is multiplied: the adaptive planner puts small partitions
    together by what it has seen, and would leave all that is made of them to one task.

    ``rows``: how many there are, where tasks hold what they read (groups, hash tables); then there are so many tasks that
    each takes about ``ROWS``, whatever the size of the table and however few pieces its files can be read in."""
    least = max(16, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-rows // ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """The frame as a written table in the shared folder: a short plan, computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/chorale-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
