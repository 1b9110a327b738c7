"""Responses with and without confirmed identities: worksheet, naive side, contrast, caps, and the older evaluation over all dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.burden import LEAST_MM, LEAST_NODAL_MM, MOST_PER_ORGAN, MOST_TARGETS, assess, best_overall, is_nodal
from strandline.registry import query
from strandline.sources.tables import table

# Tables that the functions take. events: subject, track, day, mm, assertion (machine tracks; mm or day may be null).
# members: subject, lesion (a confirmed identity), track (one of its machine tracks).
# selections: subject, lesion, organ, baseline_mm, nodal.


def _placed(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events with the confirmed identity of their track."""
    return events.join(members, ["subject", "track"])


def _measured(events: DataFrame, keys: list[str]) -> DataFrame:
    """One measurement a day: the one of the last track by name where several measured it."""
    some = events.where("mm is not null and day is not null")
    return some.groupBy(*keys, "day").agg(F.max_by("mm", F.struct("track", "mm")).alias("mm"))


def _first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.where("assertion = 'present' and day is not null").groupBy(*keys).agg(F.min("day").alias("day"))


def _after_start(first: DataFrame, own: DataFrame) -> DataFrame:
    start = own.groupBy("subject").agg(F.min("day").alias("start"))
    return first.join(start, "subject").where("day > start").select("subject", "day")


def confirmed_side(events: DataFrame, members: DataFrame, selections: DataFrame) -> DataFrame:
    """``assess`` over confirmed identities: members' measurements are one series; identities that are no target are new if first present after the start."""
    placed = _placed(events, members)
    own = _measured(placed, ["subject", "lesion"]).join(selections.select("subject", "lesion"), ["subject", "lesion"])
    others = placed.join(selections.select("subject", "lesion"), ["subject", "lesion"], "left_anti")
    return assess(own, selections, _after_start(_first_seen(others, ["subject", "lesion"]), own))


def baseline_members(events: DataFrame, members: DataFrame, selections: DataFrame) -> DataFrame:
    """Of each target the machine track measured first (the first by name among equals, or where none was measured), and whether a track is it.

    An identity without members stands for a track of its own name. Tracks without any event are none.
    """
    listed = selections.join(members, ["subject", "lesion"], "left").withColumn("track", F.coalesce("track", "lesion"))
    known = events.groupBy("subject", "track").agg(F.min(F.when(F.col("mm").isNotNull(), F.col("day"))).alias("since"))
    at = Window.partitionBy("subject", "lesion").orderBy(F.col("since").asc_nulls_last(), "track")
    return listed.join(known, ["subject", "track"]).withColumn("is_baseline", F.row_number().over(at) == 1)


def naive_side(events: DataFrame, members: DataFrame, selections: DataFrame) -> DataFrame:
    """``assess`` over machine tracks as they are: a target is the member measured first, its other members are no targets.

    So a split track that first appears after the start counts as a new lesion.
    """
    roles = baseline_members(events, members, selections)
    targets = roles.where("is_baseline").select("subject", F.col("track").alias("lesion"), "baseline_mm", "nodal")
    own = _measured(events, ["subject", "track"]).withColumnRenamed("track", "lesion").join(targets.select("subject", "lesion"), ["subject", "lesion"])
    others = events.join(roles.where("not is_baseline").select("subject", "track"), ["subject", "track"], "left_semi")
    return assess(own, targets, _after_start(_first_seen(others, ["subject", "track"]), own))


def contrast(events: DataFrame, members: DataFrame, selections: DataFrame) -> DataFrame:
    """Per subject with a selection: best response by machine tracks, by confirmed identities (only if a target merges several tracks), and whether they differ.

    Where nothing was measured the best response is NE.
    """
    naive = best_overall(naive_side(events, members, selections)).select("subject", F.col("best").alias("naive_best"))
    confirmed = best_overall(confirmed_side(events, members, selections)).select("subject", F.col("best").alias("confirmed_best"))
    merged = selections.join(members, ["subject", "lesion"]).groupBy("subject", "lesion").agg(F.countDistinct("track").alias("n")).groupBy("subject").agg(F.max("n").alias("n"))
    out = selections.select("subject").distinct().join(naive, "subject", "left").join(confirmed, "subject", "left").join(merged, "subject", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit("NE")) for c in ("naive_best", "confirmed_best")})
    best = F.when(F.col("n") > 1, F.col("confirmed_best"))
    return out.select("subject", "naive_best", best.alias("confirmed_best"), F.coalesce(best != F.col("naive_best"), F.lit(False)).alias("discrepancy"))


def selection_faults(selections: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(subject, fault) where a selection breaks a cap or holds a lesion or node that is too small to measure; of ``subjects``, also those that select nothing.

    Organs compare trimmed and in lower case, a missing one is unknown. All faults are named, not the first alone.
    """
    organ = F.coalesce(F.nullif(F.lower(F.btrim("organ")), F.lit("")), F.lit("unknown"))
    small = lambda least: F.bool_or((F.col("baseline_mm") > 0) & (F.col("baseline_mm") < least))
    nodal = F.coalesce("nodal", F.lit(False))
    per_organ = selections.groupBy("subject", organ.alias("organ"), nodal.alias("nodal")).agg(F.count("*").alias("n"), small(LEAST_MM).alias("lesion"), small(LEAST_NODAL_MM).alias("node"))
    per_organ = per_organ.groupBy("subject", "organ").agg(F.sum("n").alias("n"), F.bool_or(F.col("lesion") & ~F.col("nodal")).alias("lesion"), F.bool_or(F.col("node") & F.col("nodal")).alias("node"))
    each = per_organ.groupBy("subject").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bool_or("lesion").alias("lesion"), F.bool_or("node").alias("node"))
    if subjects is not None:
        each = subjects.select("subject").distinct().join(each, "subject", "left")
    faults = F.array(F.when(F.col("n").isNull(), "no_targets"), F.when(F.col("n") > MOST_TARGETS, "too_many_targets"), F.when(F.col("most") > MOST_PER_ORGAN, "too_many_per_organ"), F.when(F.col("node"), "node_target_too_small"), F.when(F.col("lesion"), "target_too_small"))
    return each.select("subject", F.explode(F.array_compact(faults)).alias("fault"))


# --- the fixture's events as machine tracks: views and clicks are one identity that was split


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertion = F.when(F.col("event_id") % 3 == 0, "absent").otherwise("present")
    mm = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("track"), F.to_date("ts").alias("day"), mm.alias("mm"), assertion.alias("assertion"))


def _members(events: DataFrame) -> DataFrame:
    lesion = F.when(F.col("track").isin("view", "click"), "seen").otherwise(F.col("track"))
    return events.select("subject", lesion.alias("lesion"), "track").distinct()


def _selections(events: DataFrame, members: DataFrame) -> DataFrame:
    first = _measured(_placed(events, members), ["subject", "lesion"]).where("lesion in ('seen', 'signup')").groupBy("subject", "lesion").agg(F.min_by("mm", "day").alias("baseline_mm"))
    finding = F.when(F.col("lesion") == "signup", "lymph_node_metastasis").otherwise(F.col("lesion"))
    return first.withColumn("finding", finding).select("subject", "lesion", F.substring("lesion", 1, 1).alias("organ"), "baseline_mm", is_nodal("finding").alias("nodal"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = _events(spark, sf_dir)
    members = _members(events)
    return events, members, _selections(events, members)


_BASE = """e AS (SELECT user_id AS subject, event_type AS track, CAST(ts AS DATE) AS day, CASE WHEN event_id % 4 <> 0 THEN value END AS mm, CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'present' END AS assertion FROM events),
mem AS (SELECT DISTINCT subject, CASE WHEN track IN ('view', 'click') THEN 'seen' ELSE track END AS lesion, track FROM e),
pl AS (SELECT e.*, mem.lesion FROM e JOIN mem USING (subject, track)),
md AS (SELECT subject, lesion, day, arg_max(mm, (track, mm)) AS mm FROM pl WHERE mm IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
sel AS (SELECT subject, lesion, min_by(mm, day) AS baseline_mm, lesion = 'signup' AS nodal FROM md WHERE lesion IN ('seen', 'signup') GROUP BY subject, lesion)"""


def _assess_sql(own: str, targets: str, fresh: str) -> str:
    return f"""own AS ({own}), tg AS ({targets}),
d AS (SELECT DISTINCT subject, day FROM own), st AS (SELECT subject, min(day) AS start FROM own GROUP BY subject),
g AS (SELECT d.subject, d.day, tg.nodal, tg.baseline_mm, coalesce(last_value(own.mm IGNORE NULLS) OVER (PARTITION BY d.subject, tg.lesion ORDER BY d.day ROWS UNBOUNDED PRECEDING), tg.baseline_mm) AS x
  FROM d JOIN tg USING (subject) LEFT JOIN own ON own.subject = d.subject AND own.lesion = tg.lesion AND own.day = d.day),
s AS (SELECT subject, day, round(sum(x), 6) AS sld, round(sum(baseline_mm), 6) AS base, bool_and(CASE WHEN nodal THEN x < 10 ELSE x = 0 END) AS complete FROM g GROUP BY ALL),
fr AS (SELECT DISTINCT f.subject, f.day FROM ({fresh}) f JOIN st USING (subject) WHERE f.day > st.start),
n AS (SELECT s.*, fr.day IS NOT NULL AS fresh, min(sld) OVER (PARTITION BY s.subject ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS low FROM s LEFT JOIN fr ON fr.subject = s.subject AND fr.day = s.day),
nn AS (SELECT *, CASE WHEN base > 0 THEN least(base, low) ELSE low END AS nadir FROM n),
r AS (SELECT *, CASE WHEN fresh THEN 'PD' WHEN base <= 0 THEN 'NE' WHEN complete THEN 'CR' WHEN nadir > 0 AND sld - nadir >= 5 AND (sld - nadir) * 100 >= nadir * 20 THEN 'PD'
  WHEN (sld - base) * 100 <= base * -30 THEN 'PR' ELSE 'SD' END AS response FROM nn)"""


_CONFIRMED = _assess_sql("SELECT md.* FROM md JOIN sel USING (subject, lesion)", "SELECT * FROM sel", "SELECT subject, lesion, min(day) AS day FROM pl ANTI JOIN sel USING (subject, lesion) WHERE assertion = 'present' GROUP BY ALL")
_ROLES = """k AS (SELECT subject, track, min(day) FILTER (mm IS NOT NULL) AS since FROM e GROUP BY ALL),
ro AS (SELECT sel.*, mem.track, row_number() OVER (PARTITION BY sel.subject, sel.lesion ORDER BY since NULLS LAST, mem.track) AS nth FROM sel JOIN mem USING (subject, lesion) JOIN k USING (subject, track))"""
_NAIVE = _assess_sql(
    "SELECT subject, track AS lesion, day, arg_max(e.mm, e.mm) AS mm FROM e JOIN (SELECT subject, track FROM ro WHERE nth = 1) USING (subject, track) WHERE mm IS NOT NULL AND day IS NOT NULL GROUP BY ALL",
    "SELECT subject, track AS lesion, baseline_mm, nodal FROM ro WHERE nth = 1",
    "SELECT subject, track, min(day) AS day FROM e JOIN (SELECT subject, track FROM ro WHERE nth > 1) USING (subject, track) WHERE assertion = 'present' GROUP BY ALL",
)


@query("confirmed_worksheet", f"WITH {_BASE}, {_CONFIRMED} SELECT subject, day, sld, nadir AS nadir_sld, fresh AS new_lesion, response FROM r")
def confirmed_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed_side(*_inputs(spark, sf_dir)).select("subject", "day", "sld", "nadir_sld", "new_lesion", "response")


@query("naive_worksheet", f"WITH {_BASE}, {_ROLES}, {_NAIVE} SELECT subject, day, sld, nadir AS nadir_sld, fresh AS new_lesion, response FROM r")
def naive_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_side(*_inputs(spark, sf_dir)).select("subject", "day", "sld", "nadir_sld", "new_lesion", "response")


_BEST = "CASE WHEN bool_or(response = 'PD') THEN 'PD' ELSE max_by(response, CASE response WHEN 'CR' THEN 3 WHEN 'PR' THEN 2 WHEN 'SD' THEN 1 ELSE 0 END) END"


@query("response_contrast", f"""WITH {_BASE}, {_ROLES}, a AS (WITH {_NAIVE} SELECT subject, {_BEST} AS naive_best FROM r GROUP BY subject), b AS (WITH {_CONFIRMED} SELECT subject, {_BEST} AS best FROM r GROUP BY subject),
m AS (SELECT subject, max(n) AS n FROM (SELECT subject, lesion, count(DISTINCT track) AS n FROM sel JOIN mem USING (subject, lesion) GROUP BY ALL) GROUP BY subject),
j AS (SELECT coalesce(a.subject, b.subject) AS subject, naive_best, CASE WHEN n > 1 THEN best END AS confirmed_best FROM a FULL JOIN b ON a.subject = b.subject LEFT JOIN m ON m.subject = coalesce(a.subject, b.subject))
SELECT *, coalesce(confirmed_best <> naive_best, false) AS discrepancy FROM j""")
def response_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast(*_inputs(spark, sf_dir))


@query("selection_faults", f"""WITH {_BASE}, x AS (SELECT subject, trim(lower(substr(lesion, 1, 1))) AS organ, count(*) AS n, bool_or(baseline_mm > 0 AND baseline_mm < 15 AND nodal) AS node, bool_or(baseline_mm > 0 AND baseline_mm < 10 AND NOT nodal) AS lesion FROM sel GROUP BY ALL),
y AS (SELECT subject, sum(n) AS n, max(n) AS most, bool_or(node) AS node, bool_or(lesion) AS lesion FROM x GROUP BY subject),
z AS (SELECT s.subject, y.* EXCLUDE subject FROM (SELECT DISTINCT subject FROM e) s LEFT JOIN y ON s.subject = y.subject)
SELECT subject, unnest(list_filter([CASE WHEN n IS NULL THEN 'no_targets' END, CASE WHEN n > 5 THEN 'too_many_targets' END, CASE WHEN most > 2 THEN 'too_many_per_organ' END, CASE WHEN node THEN 'node_target_too_small' END, CASE WHEN lesion THEN 'target_too_small' END], lambda x: x IS NOT NULL)) AS fault FROM z""")
def selection_faults_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, selections = _inputs(spark, sf_dir)
    return selection_faults(selections, events)


# --- the older evaluation: the least sum over all dates, no baseline in place of missing measurements


def evaluated(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Per subject: sums at the first and last day and the least of all days, changes in per cent, and the class.

    A sum takes each target's last measurement up to the day; targets without one add nothing. PD needs growth of
    20 % and 5 mm over the least sum; new lesions and growth of others are joined by the caller through ``classify_all``.
    """
    own = measured.join(targets, ["subject", "lesion"])
    grid = own.select("subject", "day").distinct().join(targets, "subject")
    upto = Window.partitionBy("subject", "lesion").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(own.select("subject", "lesion", "day", "mm"), ["subject", "lesion", "day"], "left").withColumn("mm", F.last("mm", ignorenulls=True).over(upto))
    sums = filled.groupBy("subject", "day").agg(F.round(F.sum("mm"), 2).alias("sld"))
    each = sums.groupBy("subject").agg(F.min_by("sld", "day").alias("first_sld"), F.max_by("sld", "day").alias("sld"), F.min("sld").alias("least_sld"), F.count("*").alias("n_days"))
    change = lambda of: F.when(F.col(of) > 0, F.round((F.col("sld") - F.col(of)) / F.col(of) * 100, 2))
    return each.select("*", change("first_sld").alias("from_first_pct"), change("least_sld").alias("from_least_pct"))


def classify_all(new_or_growing: Column, has_target: Column, sld: Column, least: Column, from_first: Column, from_least: Column) -> Column:
    grown = F.coalesce((from_least >= 20) & (sld - least >= 5), F.lit(False))
    return F.when(new_or_growing, "PD").when(~has_target, "Unknown").when(sld == 0, "CR").when(grown, "PD").when(from_first <= -30, "PR").otherwise("SD")


#: What measurements, targets, days and a sign of new lesions add to the confidence.
MEASURED_PART, TARGETS_PART, DAYS_PART, SIGN_PART = 0.35, 0.35, 0.2, 0.1


def completeness(n_targets: Column, n_days: Column, new_signal: Column, measured: Column) -> Column:
    """Confidence from what there is: for measurements, for up to five targets, for up to four days, for a sign of new lesions."""
    total = measured.cast("int") * MEASURED_PART + F.least(n_targets / 5, F.lit(1.0)) * TARGETS_PART + F.least(n_days / 4, F.lit(1.0)) * DAYS_PART + new_signal.cast("int") * SIGN_PART
    return F.round(F.least(total, F.lit(1.0)), 2)


_OLD = f"""{_BASE}, tg AS (SELECT subject, lesion FROM sel), own AS (SELECT md.* FROM md JOIN tg USING (subject, lesion)), d AS (SELECT DISTINCT subject, day FROM own),
g AS (SELECT d.subject, d.day, last_value(own.mm IGNORE NULLS) OVER (PARTITION BY d.subject, tg.lesion ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS x FROM d JOIN tg USING (subject) LEFT JOIN own ON own.subject = d.subject AND own.lesion = tg.lesion AND own.day = d.day),
s AS (SELECT subject, day, round(sum(x), 2) AS sld FROM g GROUP BY ALL),
v AS (SELECT subject, min_by(sld, day) AS first_sld, max_by(sld, day) AS sld, min(sld) AS least_sld, count(*) AS n_days FROM s GROUP BY subject),
w AS (SELECT *, CASE WHEN first_sld > 0 THEN round((sld - first_sld) / first_sld * 100, 2) END AS from_first_pct, CASE WHEN least_sld > 0 THEN round((sld - least_sld) / least_sld * 100, 2) END AS from_least_pct FROM v),
nt AS (SELECT DISTINCT subject FROM md ANTI JOIN tg USING (subject, lesion) WHERE mm > 200)"""


@query("evaluation_over_all_dates", f"""WITH {_OLD} SELECT w.*, CASE WHEN nt.subject IS NOT NULL THEN 'PD' WHEN sld = 0 THEN 'CR' WHEN coalesce(from_least_pct >= 20 AND sld - least_sld >= 5, false) THEN 'PD' WHEN from_first_pct <= -30 THEN 'PR' ELSE 'SD' END AS response,
round(least(0.35 + least(k.n / 5, 1.0) * 0.35 + least(n_days / 4, 1.0) * 0.2 + CASE WHEN nt.subject IS NOT NULL THEN 0.1 ELSE 0 END, 1.0), 2) AS confidence FROM w JOIN (SELECT subject, count(*) AS n FROM tg GROUP BY subject) k USING (subject) LEFT JOIN nt USING (subject)""")
def evaluation_over_all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of over 200 in lesions that are no targets stand for their growth."""
    events, members, selections = _inputs(spark, sf_dir)
    targets, measured = selections.select("subject", "lesion"), _measured(_placed(events, members), ["subject", "lesion"])
    growing = measured.join(targets, ["subject", "lesion"], "left_anti").where("mm > 200").select("subject").distinct().withColumn("growing", F.lit(True))
    out = evaluated(measured, targets).join(targets.groupBy("subject").agg(F.count("*").alias("n_targets")), "subject").join(growing, "subject", "left")
    grows = F.coalesce("growing", F.lit(False))
    response = classify_all(grows, F.col("n_targets") > 0, F.col("sld"), F.col("least_sld"), F.col("from_first_pct"), F.col("from_least_pct"))
    return out.select("subject", "first_sld", "sld", "least_sld", "n_days", "from_first_pct", "from_least_pct", response.alias("response"), completeness(F.col("n_targets"), F.col("n_days"), grows, F.lit(True)).alias("confidence"))

