import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"{made}/shared")
        .config("spark.sql.warehouse.dir", f"{made}/warehouse")
        .config("spark.local.dir", f"{made}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of SF; a frame."""
    duckdb = pytest.importorskip("duckdb")

    def run(sql: str, folder: str = SF):
        con = duckdb.connect()
        for f in os.listdir(folder):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
        found = con.sql(sql)
        frame = found.df()
        for name, kind in zip(found.columns, found.types, strict=True):
            if str(kind) == "DATE":  # pandas gets these as times of day zero, Spark's dates as dates
                frame[name] = frame[name].dt.date
        return frame

    return run


def same_rows(left, right) -> None:
    """Two pandas frames hold the same rows in any order; floats to nine digits."""
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    assert len(left) == len(right)

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    rows = lambda f: sorted([plain(v) for v in r] for r in f[names].astype(object).itertuples(index=False))
    assert rows(left) == rows(right)
