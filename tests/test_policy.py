"""Filters on findings, by hand."""

from pyspark.sql import functions as F

from strandline.operators import policy


def test_negation(spark):
    rows = [(False, "cyst", "pain", True), (True, "cyst", "pain", False), (True, "cyst", " \n", True), (True, "cyst", None, True), (True, "No Mass-effect", "pain", True), (True, "knee pain", "Pain?", True), (True, None, "pain", False), (None, "cyst", "pain", True)]
    out = spark.createDataFrame(rows, "n boolean, name string, asked string, want boolean")
    assert all(r[0] == r[1] for r in out.select("want", policy.negation_kept(F.col("n"), F.col("name"), F.col("asked"))).collect())


def test_in_report(spark):
    text = "There is a large Nodule in the left lobe."
    rows = [("nodule", "large nodule seen here", text, True), ("nodule", "small mass seen here large", text, False), ("cyst", "large nodule", text, False), ("the finding", None, text, True), ("", "large nodule", text, False), ("od", "in it", text, True), ("nodule", "large", None, False), ("lob", "", text, True)]
    out = spark.createDataFrame(rows, "name string, evidence string, report string, want boolean")
    assert all(r[0] == r[1] for r in out.select("want", policy.in_current_report(F.col("name"), F.col("evidence"), F.col("report"))).collect())


def test_covered(spark):
    rows = [(1, 0, policy.COMPOUND, "Air  fluid level", "left"), (1, 1, "pneumothorax", "air fluid\nlevel", "left"), (1, 2, "pleural_effusion", "air fluid level", "right"), (2, 3, "pneumothorax", "air fluid level", "left"), (1, 4, "nodule", "air fluid level", "left"),
            (3, 5, policy.COMPOUND, None, None), (3, 6, "pleural_effusion", " ", None)]
    out = policy.without_covered(spark.createDataFrame(rows, "report int, nth int, kind string, evidence string, side string"), "report")
    assert sorted(r.nth for r in out.collect()) == [0, 2, 3, 4, 5]
