"""Small series with ties, nulls and long runs against results worked out by hand."""

from datetime import datetime, timedelta

from strandline.operators.longitudinal import as_of, change_label, segments
from strandline.operators.readers import band
from strandline.streaming.appends import run_batches

T0 = datetime(2024, 1, 1)


def test_as_of(spark):
    at = [T0 + timedelta(hours=i) for i in range(5)]
    asked = spark.createDataFrame([("a", at[0], 1), ("a", at[2], 2), ("a", at[4], 3), ("b", at[1], 4), (None, at[1], 5)], "k string, t timestamp_ntz, id int")
    known = spark.createDataFrame([("a", at[1], 1.0), ("a", at[2], 2.0), ("a", at[3], None), ("a", at[2], 5.0), ("c", at[0], 9.0)], "k string, t timestamp_ntz, v double")
    found = {r.id: r.v for r in as_of(asked, known, "k", "t", "v").collect()}
    assert found == {1: None, 2: 5.0, 3: 5.0, 4: None, 5: None}


def test_as_of_of_nothing(spark):
    none = spark.createDataFrame([], "k string, t timestamp_ntz, id int")
    known = spark.createDataFrame([("a", T0, 1.0)], "k string, t timestamp_ntz, v double")
    assert as_of(none, known, "k", "t", "v").count() == 0


def test_segments_are_cut_by_gaps_and_size(spark):
    close = [("a", T0 + timedelta(seconds=i), i) for i in range(45)]
    late = [("a", T0 + timedelta(seconds=44 + 3601), 100), ("a", T0 + timedelta(seconds=44 + 3601 + 3600), 101)]
    rows = spark.createDataFrame(close + late, "k string, t timestamp_ntz, id int")
    found = [r.n for r in segments(rows, "k", "t", "id").orderBy("start").collect()]
    assert found == [20, 20, 5, 2]


def test_labels_at_their_bounds(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(111.0, 100.0), (110.0, 100.0), (89.0, 100.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(change_label(F.col("a"), F.col("b"))).collect()] == ["worsening", "stable", "improving", None, None]
    rows = spark.createDataFrame([(-0.1,), (0.0,), (0.2,), (0.8,), (None,)], "a double")
    assert [r[0] for r in rows.select(band(F.col("a"))).collect()] == ["poor", "slight", "fair", "almost perfect", None]


def test_a_stream_that_is_started_again_appends_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id long, v string").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in").dropDuplicates(["id", "v"])
    assert run_batches(stream(), f"{tmp_path}/out", "append").count() == 2
    assert run_batches(stream(), f"{tmp_path}/out", "append").count() == 2
    spark.createDataFrame([(2, None), (3, "y")], "id long, v string").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in run_batches(stream(), f"{tmp_path}/out", "append").collect()) == [1, 2, 3]
