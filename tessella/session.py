"""The session and its written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a cluster; a submit script can override each.
CLUSTER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with CLUSTER's settings and those given (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    for k, v in {**CLUSTER, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows that one task of row-by-row work takes.
TASK_ROWS = 10_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to a task for each TASK_ROWS of its rows (those of a written table are counted): small files of short rows make few tasks, however long a row's work takes."""
    return df.repartition((df.count() if rows is None else rows) // TASK_ROWS + 1, *keys)


class Tables:
    """Stage tables in the shared folder of spark.checkpoint.dir: each cuts its lineage and is a place to restart from.

    A local master without that setting gets a temporary folder; a cluster must have it."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.at = spark, f"{base.rstrip('/')}/tables/{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def put_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {k: self.put(v, k) for k, v in tables.items()}
