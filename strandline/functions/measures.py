"""Measurements, dates and certainty: parsers, scores and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

#: A measurement, its numbers, bounds of certainty from high to low, formats of dates in the order in which they are tried.
SIZE = r"\d+(?:\.\d+)?(?:\s*x\s*\d+(?:\.\d+)?)*\s*(?:mm|cm)\b"
NUMBER = r"\d+(?:\.\d+)?"
CERTAIN = ((0.9, "confirmed"), (0.7, "probable"), (0.5, "possible"))
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")
NODAL = "lymph|nodal|node"


def sizes_mm(x: Column) -> Column:
    """All diameters of all measurements of a text in mm, in order; a unit holds for all numbers in front of it."""
    def of_hit(hit: Column) -> Column:
        scale = F.when(hit.endswith("cm"), 10.0).otherwise(1.0)
        return F.transform(F.regexp_extract_all(hit, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.round(n.cast("double") * scale, 3))

    return F.flatten(F.transform(F.regexp_extract_all(x, F.lit(f"({SIZE})"), F.lit(1)), of_hit))


def diameter(sizes: Column, nodal: Column) -> Column:
    """The short axis of a node, the longest diameter of anything else; null without one."""
    return F.when(nodal, F.array_min(sizes)).otherwise(F.array_max(sizes))


def flexible_date(x: Column) -> Column:
    """A date in any of FORMATS, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in FORMATS))


def certainty_label(score: Column) -> Column:
    found = F.when(score.isNull(), "unknown")
    for bound, name in CERTAIN:
        found = found.when(score >= bound, name)
    return found.otherwise("unlikely")


def boosted(score: Column) -> Column:
    """A score confirmed by another source: a tenth more, at most 1."""
    return F.least(F.lit(1.0), F.round(score * 1.1, 3))


def span_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Shared length over the shorter span's; 0 where a span is empty or they don't meet."""
    shared = F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))
    return F.coalesce(F.try_divide(shared, F.least(end - start, other_end - other_start)), F.lit(0.0))


@query("measured_sizes", r"""SELECT p_partkey, array_to_string(list_transform(mm, lambda v: CAST(CAST(v AS DECIMAL(18, 1)) AS VARCHAR)), ';') AS sizes, CASE WHEN nodal THEN list_min(mm) ELSE list_max(mm) END AS diameter FROM (
  SELECT p_partkey, p_size % 5 = 0 AS nodal, flatten(list_transform(regexp_extract_all(t, '\d+(?:\.\d+)?(?:\s*x\s*\d+(?:\.\d+)?)*\s*(?:mm|cm)\b'), lambda h: list_transform(regexp_extract_all(h, '\d+(?:\.\d+)?'), lambda n: round(CAST(n AS DOUBLE) * CASE WHEN h LIKE '%cm' THEN 10 ELSE 1 END, 3)))) AS mm FROM (
    SELECT p_partkey, p_size, p_name || ' ' || p_size || '.5 x ' || (p_partkey % 7 + 1) || CASE WHEN p_partkey % 2 = 0 THEN ' cm' ELSE ' mm' END || ', before ' || (p_partkey % 11) || 'mm of 3' AS t FROM part))""")
def measured_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 2 == 0, " cm").otherwise(" mm")
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 x "), (F.col("p_partkey") % 7 + 1).cast("string"), unit, F.lit(", before "), (F.col("p_partkey") % 11).cast("string"), F.lit("mm of 3"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5 == 0).alias("nodal"), sizes_mm(text).alias("mm"))
    shown = F.array_join(F.transform("mm", lambda v: v.cast("decimal(18,1)").cast("string")), ";")
    return rows.select("p_partkey", shown.alias("sizes"), diameter(F.col("mm"), F.col("nodal")).alias("diameter"))


@query("flexible_dates", """SELECT o_orderkey, CAST(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%d.%m.%Y')) AS DATE) AS day FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'n/a' END AS t FROM orders)""")
def flexible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    text = F.when(k == 3, "n/a")
    for i, f in enumerate(FORMATS):
        text = text.when(k == i, F.date_format(day, f))
    return table(spark, sf_dir, "orders").select("o_orderkey", flexible_date(text).alias("day"))


@query("nearest_days", """SELECT a.o_custkey, min(abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)))) AS days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
  WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' AND a.o_orderdate IS NOT NULL AND b.o_orderdate IS NOT NULL GROUP BY a.o_custkey""")
def nearest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest days between events of two kinds of a key. The nearest pair stands side by side among a key's sorted days, so no pairs are formed."""
    days = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'F')").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day")).where("day is not null").distinct()
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderstatus").rowsBetween(Window.unboundedPreceding, -1)
    other = lambda kind: F.last(F.when(F.col("o_orderstatus") == kind, F.col("day")), ignorenulls=True).over(w)
    gap = F.datediff("day", F.when(F.col("o_orderstatus") == "O", other("F")).otherwise(other("O")))
    return days.select("o_custkey", gap.alias("gap")).groupBy("o_custkey").agg(F.min("gap").cast("long").alias("days")).where("days is not null")


@query("report_range", """SELECT o_custkey, CASE WHEN a = b THEN a ELSE a || ' to ' || b END AS span FROM (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM orders GROUP BY o_custkey)""")
def report_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).cast("string").alias("a"), F.max(F.to_date("o_orderdate")).cast("string").alias("b"))
    return ends.select("o_custkey", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws(" to ", "a", "b")).alias("span"))


@query("date_order_issues", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)")
def date_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends that lie before their starts."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    return both.select("l_orderkey", "l_linenumber", days.alias("days")).where("days < 0")


@query("certainty_labels", """SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.9 THEN 'confirmed' WHEN s >= 0.7 THEN 'probable' WHEN s >= 0.5 THEN 'possible' WHEN s IS NULL THEN 'unknown' ELSE 'unlikely' END AS label, least(1.0, round(s * 1.1, 3)) AS boosted
  FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s FROM lineitem)""")
def certainty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", certainty_label(F.col("s")).alias("label"), boosted(F.col("s")).alias("boosted"))


@query("span_overlaps", """SELECT l_orderkey, l_linenumber, round(CASE WHEN least(e, f) - greatest(s, r) > 0 THEN (least(e, f) - greatest(s, r)) / least(e - s, f - r) ELSE 0 END, 4) AS overlap FROM (
  SELECT l_orderkey, l_linenumber, s, s + l_quantity AS e, lead(s) OVER w AS r, lead(s + l_quantity) OVER w AS f FROM (SELECT *, CAST(l_partkey % 50 AS DOUBLE) AS s FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, s, l_quantity)) WHERE r IS NOT NULL""")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each span with the next of its report; equal line numbers are told apart by the spans."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "s", "l_quantity")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("double").alias("s"), "l_quantity").withColumn("e", F.col("s") + F.col("l_quantity"))
    s = s.withColumns({"r": F.lead("s").over(w), "f": F.lead("e").over(w)}).where("r is not null")
    return s.select("l_orderkey", "l_linenumber", F.round(span_overlap(F.col("s"), F.col("e"), F.col("r"), F.col("f")), 4).alias("overlap"))
