"""Intermediate tables in the shared folder, and their removal when the job that owns them is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chorale.session import checkpoint_dir


class Scratch:
    """Tables of one operator call. ``cut`` writes a frame to the shared folder and rereads it (short plan, computed
    once, safe when executors are lost); ``keep`` does so for the result and removes all other tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[str] = []
        self.tables: list[str] = []

    def path(self) -> str:
        return f"{checkpoint_dir(self.spark)}/llm-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        out = self.cut(df)
        self.made.pop()
        self.clear()
        return out

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """One row of the frame for each ``key`` as a table in buckets of it: joins on the key alone read the table where it
        lies and shuffle the other side only."""
        n, name, path = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"llm_{uuid.uuid4().hex}", self.path()
        df.repartition(n, key).dropDuplicates([key]).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
        self.made.append(path)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, df: DataFrame) -> None:
        """Removes the table behind a frame that ``cut`` returned."""
        for path in [p for p in self.made if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles())]:
            self._remove(path)
            self.made.remove(path)

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.made:
            self._remove(path)
        self.tables.clear()
        self.made.clear()

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
