"""Text and measurement functions and the ancestor closure on small rows."""

from pyspark.sql import functions as F

from strandline.functions import measures, text
from strandline.operators.identity import closure


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_normalisers(spark):
    assert one(spark, " Left-Lobe, upper ", text.slot_token) == "left_lobe_upper"
    assert one(spark, " -- ", text.slot_text) == "unknown"
    assert one(spark, None, text.slot_text) == "unknown"
    assert one(spark, "Left-Lobe, upper", text.link_token) == "left_lobe,_upper"
    assert one(spark, "", text.slot_token) == ""


def test_labels_and_negation(spark):
    assert one(spark, "unchanged but new", lambda x: text.first_label(x, text.CHANGE, "none")) == "stable"
    assert one(spark, None, lambda x: text.first_label(x, text.CHANGE, "none")) == "none"
    assert one(spark, "there is no mass", lambda x: text.negated_near(x, "mass")) is True
    assert one(spark, "there is a mass", lambda x: text.negated_near(x, "mass")) is False
    assert one(spark, "clear", lambda x: text.negated_near(x, "mass")) is None
    assert one(spark, "no" + " " * 60 + "mass", lambda x: text.negated_near(x, "mass")) is False


def test_lexical_match(spark):
    rows = spark.createDataFrame([("the liver mass", "mass of liver"), ("the lung", "a kidney"), ("ab", ""), ("to", "of")], "a string, b string")
    assert [r[0] for r in rows.select(text.lexical_match(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_measurements(spark):
    assert one(spark, "3.2 x 2.1 cm, was 18 mm; grade 3", measures.sizes_mm) == [32.0, 21.0, 18.0]
    assert one(spark, "none", measures.sizes_mm) == []
    assert one(spark, "none", lambda x: measures.diameter(measures.sizes_mm(x), F.lit(True))) is None
    assert one(spark, "3 x 2 cm", lambda x: measures.diameter(measures.sizes_mm(x), F.lit(True))) == 20.0
    assert str(one(spark, "05/03/2024", measures.flexible_date)) == "2024-03-05"
    assert one(spark, "soon", measures.flexible_date) is None


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (1, 3)], "child int, parent int")
    assert sorted(map(tuple, closure(edges).collect())) == [(1, 2), (1, 3), (2, 3), (4, 3)]
    assert closure(edges.limit(0)).count() == 0
