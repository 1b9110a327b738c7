"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the text contracts: a run without blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where nothing is configured and everything runs on this machine (local mode, as in tests) a folder is
    made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/strandline-{tag}-{uuid.uuid4().hex[:12]}"


def park(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables parked for a while: ``clear`` removes those that are not to be kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def park(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_folder(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def clear(self, *keep: DataFrame) -> None:
        kept = {id(df) for df in keep}
        for key in [k for k in self.paths if k not in kept]:
            remove_folder(self.spark, self.paths.pop(key)[0])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` named, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """While this holds, what Python workers get at once is limited to so many bytes (or one row): what they hold follows from it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def other_columns(df: DataFrame, *names: str, prefix: str = "") -> list[str]:
    """The columns of ``df`` but those an operator adds or uses: ``names``, and all that begin with ``prefix``. Case doesn't matter, as in Spark."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken and not (prefix and c.lower().startswith(prefix))]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; rows without an id have fold -1 (never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
