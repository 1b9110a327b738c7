"""Reading the fixture tables, and tables that hold intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a folder of this machine only where nothing is configured and all runs here (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
    return f"{base.rstrip('/')}/strandline-{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, path: str | None = None, clear: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, however often it is used. ``clear``: what was shuffled for it is deleted at once."""
    spark, path, name = df.sparkSession, path or new_folder(df.sparkSession, tag), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if clear:
        spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        if clear:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made at ``path``, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of half a million of ``rows``, where the session's shuffle partitions would get more than that."""
    tasks = rows // 500_000
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
