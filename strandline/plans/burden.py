"""Burden timelines: target selection, carried-forward sums, response classes and the best overall response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

#: Fixed values of the response rules.
MOST_TARGETS, MOST_PER_ORGAN, LEAST_MM = 5, 2, 10.0
LEAST_NODAL_MM, NORMAL_NODE_MM = 15.0, 10.0  # a node counts from 15 mm of its short axis on, and is normal below 10
NODAL = "lymph|nodal|node"
SHRINK_PCT, GROW_PCT, GROW_MM = -30.0, 20.0, 5.0


def is_nodal(*names: str) -> Column:
    """Whether finding type, anatomy or organ names a lymph node; nulls name nothing, a nodule is none."""
    return F.coalesce(F.lower(F.concat_ws(" ", *names)).rlike(NODAL), F.lit(False))


def diameter(normalized: str, value: str, values: str, nodal: str) -> Column:
    """The diameter of a measurement: the normalised one, else the plain value, else the short axis of a node or the long axis of anything else."""
    axes = F.filter(values, lambda x: x.isNotNull())
    return F.coalesce(F.col(normalized), F.col(value), F.when(F.col(nodal), F.array_min(axes)).otherwise(F.array_max(axes)))


def series(events: DataFrame) -> DataFrame:
    """(subject, lesion, organ, nodal, day, mm): one measurement a day, the larger of a day's, of nodes the smaller. Sign-ups stand for nodes."""
    named = events.withColumn("finding", F.when(F.col("event_type") == "signup", "lymph_node").otherwise(F.col("event_type")))
    keys = [F.col("user_id").alias("subject"), F.col("event_type").alias("lesion"), F.substring("event_type", 1, 1).alias("organ"), is_nodal("finding").alias("nodal"), F.to_date("ts").alias("day")]
    mm = F.when(F.col("nodal"), F.min("value")).otherwise(F.max("value"))
    return named.where("value is not null and ts is not null").groupBy(*keys).agg(mm.alias("mm"))


def select_targets(measured: DataFrame) -> DataFrame:
    """Largest first measurements of at least LEAST_MM, of nodes LEAST_NODAL_MM: at most MOST_PER_ORGAN of an organ and MOST_TARGETS of a subject."""
    first = measured.groupBy("subject", "lesion", "organ", "nodal").agg(F.min_by("mm", "day").alias("baseline_mm"), F.min("day").alias("first_day"))
    big = [F.desc("baseline_mm"), F.col("lesion")]
    of_organ = F.row_number().over(Window.partitionBy("subject", "organ").orderBy(*big))
    measurable = F.col("baseline_mm") >= F.when(F.col("nodal"), LEAST_NODAL_MM).otherwise(LEAST_MM)
    ranked = first.where(measurable).withColumn("in_organ", of_organ).where(F.col("in_organ") <= MOST_PER_ORGAN)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(*big))).where(F.col("rank") <= MOST_TARGETS).drop("in_organ")


def classify(sld: Column, baseline: Column, nadir: Column, new_lesion: Column, complete: Column) -> Column:
    """PD for a new lesion, NE without a baseline, CR, PD for growth over the nadir, PR, else SD; in this order of precedence.

    Growth is counted in per cent of the nadir: from a nadir of zero nothing grows.
    """
    grown = (nadir > 0) & (sld - nadir >= GROW_MM) & ((sld - nadir) * 100 >= nadir * GROW_PCT)
    shrunk = (sld - baseline) * 100 <= baseline * SHRINK_PCT
    return F.when(new_lesion, "PD").when(baseline <= 0, "NE").when(complete, "CR").when(grown, "PD").when(shrunk, "PR").otherwise("SD")


def assess(own: DataFrame, targets: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per subject and day on which a target was measured: the sum of targets, each carried forward (or its baseline), the running nadir, and the class.

    ``own``: subject, lesion, day, mm of targets; ``targets``: subject, lesion, baseline_mm, nodal; ``fresh``:
    subject and day of new lesions. A response is complete if every target is gone, nodes if below NORMAL_NODE_MM.
    """
    days = own.select("subject", "day").distinct()
    grid = days.join(targets.select("subject", "lesion", "baseline_mm", "nodal"), "subject")
    upto = Window.partitionBy("subject", "lesion").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(own.select("subject", "lesion", "day", "mm"), ["subject", "lesion", "day"], "left")
    filled = filled.withColumn("at", F.coalesce(F.last("mm", ignorenulls=True).over(upto), "baseline_mm"))
    gone = F.when(F.col("nodal"), F.col("at") < NORMAL_NODE_MM).otherwise(F.col("at") == 0)
    sums = filled.groupBy("subject", "day").agg(F.round(F.sum("at"), 6).alias("sld"), F.round(F.sum("baseline_mm"), 6).alias("baseline_sld"), F.bool_and(gone).alias("complete"))
    run = Window.partitionBy("subject").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = sums.join(fresh.select("subject", "day").distinct().withColumn("new_lesion", F.lit(True)), ["subject", "day"], "left")
    out = out.withColumn("new_lesion", F.coalesce("new_lesion", F.lit(False)))
    lowest = F.min("sld").over(run)
    out = out.withColumn("nadir_sld", F.when(F.col("baseline_sld") > 0, F.least("baseline_sld", lowest)).otherwise(lowest))
    return out.withColumn("response", classify(F.col("sld"), F.col("baseline_sld"), F.col("nadir_sld"), F.col("new_lesion"), F.col("complete")))


def timeline(measured: DataFrame) -> DataFrame:
    """``assess`` of the targets selected from ``measured``; lesions that are none are new if first measured after the first day of a target."""
    targets = select_targets(measured)
    own = measured.join(targets.select("subject", "lesion", "baseline_mm"), ["subject", "lesion"])
    others = measured.join(targets.select("subject", "lesion"), ["subject", "lesion"], "left_anti").groupBy("subject", "lesion").agg(F.min("day").alias("day"))
    start = own.groupBy("subject").agg(F.min("day").alias("start"))
    return assess(own, targets, others.join(start, "subject").where("day > start"))


def best_overall(responses: DataFrame) -> DataFrame:
    """Per subject: PD if any, else the best of CR, PR, SD, NE."""
    rank = F.map_from_arrays(F.array(*map(F.lit, ("NE", "SD", "PR", "CR"))), F.array(*map(F.lit, range(4))))
    best = F.when(F.bool_or(F.col("response") == "PD"), "PD").otherwise(F.max_by("response", rank[F.col("response")]))
    return responses.groupBy("subject").agg(best.alias("best"), F.count("*").alias("n_timepoints"))


_SERIES = """m AS (SELECT user_id AS subject, event_type AS lesion, substr(event_type, 1, 1) AS organ, event_type = 'signup' AS nodal, CAST(ts AS DATE) AS day,
  if(bool_and(event_type = 'signup'), min(value), max(value)) AS mm
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""
_TARGETS = f"""f AS (SELECT subject, lesion, organ, nodal, min_by(mm, day) AS baseline_mm, min(day) AS first_day FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY subject, organ ORDER BY baseline_mm DESC, lesion) AS in_organ FROM f WHERE baseline_mm >= CASE WHEN nodal THEN {LEAST_NODAL_MM} ELSE {LEAST_MM} END),
t AS (SELECT * EXCLUDE in_organ FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY baseline_mm DESC, lesion) AS rank FROM o WHERE in_organ <= {MOST_PER_ORGAN}) WHERE rank <= {MOST_TARGETS})"""
_TIMELINE = f"""WITH {_SERIES}, {_TARGETS},
own AS (SELECT m.*, t.baseline_mm FROM m JOIN t USING (subject, lesion)),
d AS (SELECT DISTINCT subject, day FROM own),
g AS (SELECT d.subject, d.day, t.lesion, t.nodal, t.baseline_mm, own.mm FROM d JOIN t USING (subject) LEFT JOIN own ON own.subject = d.subject AND own.lesion = t.lesion AND own.day = d.day),
l AS (SELECT *, coalesce(last_value(mm IGNORE NULLS) OVER (PARTITION BY subject, lesion ORDER BY day ROWS UNBOUNDED PRECEDING), baseline_mm) AS mm_at FROM g),
s AS (SELECT subject, day, round(sum(mm_at), 6) AS sld, round(sum(baseline_mm), 6) AS baseline_sld,
  bool_and(CASE WHEN nodal THEN mm_at < {NORMAL_NODE_MM} ELSE mm_at = 0 END) AS complete FROM l GROUP BY ALL),
fresh AS (
  SELECT DISTINCT x.subject, x.day FROM (SELECT subject, lesion, min(day) AS day FROM m ANTI JOIN t USING (subject, lesion) GROUP BY ALL) x
  JOIN (SELECT subject, min(day) AS start FROM d GROUP BY ALL) y USING (subject) WHERE x.day > y.start),
n AS (
  SELECT s.*, fresh.day IS NOT NULL AS new_lesion, least(baseline_sld, min(sld) OVER (PARTITION BY s.subject ORDER BY s.day ROWS UNBOUNDED PRECEDING)) AS nadir_sld
  FROM s LEFT JOIN fresh ON fresh.subject = s.subject AND fresh.day = s.day),
r AS (
  SELECT *, CASE WHEN new_lesion THEN 'PD' WHEN baseline_sld <= 0 THEN 'NE' WHEN complete THEN 'CR'
    WHEN nadir_sld > 0 AND sld - nadir_sld >= {GROW_MM} AND (sld - nadir_sld) * 100 >= nadir_sld * {GROW_PCT} THEN 'PD'
    WHEN (sld - baseline_sld) * 100 <= baseline_sld * {SHRINK_PCT} THEN 'PR' ELSE 'SD' END AS response
  FROM n)"""


@query("burden_targets", f"WITH {_SERIES}, {_TARGETS} SELECT subject, lesion, organ, nodal, baseline_mm, first_day, CAST(rank AS INT) AS rank FROM t")
def burden_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_targets(series(table(spark, sf_dir, "events")))


@query("burden_timeline", f"{_TIMELINE} SELECT subject, day, sld, baseline_sld, complete, new_lesion, nadir_sld, response FROM r")
def burden_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(series(table(spark, sf_dir, "events")))


@query(
    "burden_best",
    f"""{_TIMELINE} SELECT subject, CASE WHEN bool_or(response = 'PD') THEN 'PD'
  ELSE max_by(response, CASE response WHEN 'CR' THEN 3 WHEN 'PR' THEN 2 WHEN 'SD' THEN 1 ELSE 0 END) END AS best, count(*) AS n_timepoints FROM r GROUP BY subject""",
)
def burden_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_overall(timeline(series(table(spark, sf_dir, "events"))))
