"""Operators over identities: ids from content, ancestors, latest values, conflicts, anti-joins and status by the latest day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.review import clinical_sections
from strandline.plans.burden import _TIMELINE, GROW_MM, GROW_PCT, SHRINK_PCT, classify, series, timeline
from strandline.registry import oracles_so_far, query
from strandline.sources.tables import table

#: References in the order asked for.
REFS = (17, 3, 999, 42, 5)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (child, ancestor) of an acyclic hierarchy with columns child and parent, each once. Made for dimension tables, whose depth is small."""
    found = edges.sparkSession.sql(
        "WITH RECURSIVE up(child, parent) AS (SELECT child, parent FROM {edges} UNION ALL SELECT up.child, e.parent FROM up JOIN {edges} e ON up.parent = e.child) SELECT DISTINCT child, parent AS ancestor FROM up",
        edges=edges,
    )
    return found


@query("event_ids", "SELECT event_id, 'frame_event_' || substr(sha256(user_id || '|' || event_type || '|' || props), 1, 16) AS content_id FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND props IS NOT NULL")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on content alone, so a rerun gives the same."""
    rows = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null and props is not null")
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")
    return rows.select("event_id", F.concat(F.lit("frame_event_"), F.substring(F.sha2(key, 256), 1, 16)).alias("content_id"))


@query("ancestor_closure", """WITH RECURSIVE e AS (SELECT n_nationkey AS child, n_nationkey // 3 AS parent FROM nation WHERE n_nationkey > 0),
up(child, parent) AS (SELECT child, parent FROM e UNION ALL SELECT up.child, e.parent FROM up JOIN e ON up.parent = e.child) SELECT DISTINCT child, parent AS ancestor FROM up""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(table(spark, sf_dir, "nation").where("n_nationkey > 0").selectExpr("n_nationkey AS child", "cast(n_nationkey div 3 AS int) AS parent"))


@query("latest_value", """SELECT user_id, event_type, max_by(value, (ts IS NULL, ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last date; undated values stand after dated ones."""
    at = F.struct(F.col("ts").isNull(), "ts", "event_id")
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.max_by("value", at).alias("value"))


@query("ordered_refs", f"SELECT p.c_custkey, place, c_name FROM (SELECT unnest({list(REFS)})::BIGINT AS c_custkey, unnest(range({len(REFS)})) AS place) p JOIN customer c ON c.c_custkey = p.c_custkey")
def ordered_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows asked for by a list, each with its place in it."""
    asked = spark.range(1).select(F.posexplode(F.array(*(F.lit(r).cast("long") for r in REFS))).alias("place", "c_custkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(asked), "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"), "c_name")


@query("conflict_pairs", """WITH v AS (SELECT o_custkey, o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.o_orderpriority, a.s AS left_value, b.s AS right_value, a.n * b.n AS n_pairs FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.s < b.s""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of an entity that contradict each other. Facts are counted by value first, so an entity with many facts joins only its few values."""
    keys = ["o_custkey", "o_orderpriority"]
    v = table(spark, sf_dir, "orders").groupBy(*keys, "o_orderstatus").agg(F.count("*").alias("n"))
    a, b = (v.select(*keys, F.col("o_orderstatus").alias(f"{side}_value"), F.col("n").alias(f"{side}_n")) for side in ("left", "right"))
    return a.join(b, keys).where("left_value < right_value").select(*keys, "left_value", "right_value", (F.col("left_n") * F.col("right_n")).alias("n_pairs"))


@query("catch_all_dedupe", """SELECT event_id, user_id, true AS review_only FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND CAST(c.ts AS DATE) = CAST(e.ts AS DATE))""")
def catch_all_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General findings that a specific one of the same subject and day doesn't cover, kept for review only."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    known = rows.where("event_type = 'click'").select("user_id", "day").distinct()
    return rows.where("event_type = 'view'").join(known, ["user_id", "day"], "left_anti").select("event_id", "user_id", F.lit(True).alias("review_only"))


@query("task_list", """SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_items, count(DISTINCT o_orderkey) AS n_records, count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) AS n_started FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, records and started items of a task. Records are counted per item before the join, so no distinct counts are left."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"))
    items = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").distinct().join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return items.groupBy("c_mktsegment").agg(F.count("*").alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count("n").alias("n_started"))


@query("entity_status", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_and(value < 50) AS none, bool_or(value < 50) AS part, bool_or(value >= 50) AS present FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
l AS (SELECT user_id, max_by(none, day) AS none, max_by(part, day) AS part, bool_or(present) AS ever FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN none AND ever THEN 'resolved' WHEN none THEN 'absent' WHEN part THEN 'mixed' ELSE 'active' END AS status FROM l""")
def entity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions of the latest day decide: all negated is resolved after any present one, else absent; some is mixed."""
    negated = F.col("value") < 50
    day = table(spark, sf_dir, "events").where("value is not null and ts is not null").groupBy("user_id", F.to_date("ts").alias("day"))
    day = day.agg(F.struct(F.bool_and(negated).alias("none"), F.bool_or(negated).alias("some")).alias("v"), F.bool_or(~negated).alias("present"))
    last = day.groupBy("user_id").agg(F.max_by("v", "day").alias("v"), F.bool_or("present").alias("ever"))
    status = F.when(F.col("v.none") & F.col("ever"), "resolved").when(F.col("v.none"), "absent").when(F.col("v.some"), "mixed").otherwise("active")
    return last.select("user_id", status.alias("status"))


@query("digest_counts", f"SELECT section, count(*) AS n_tracks, count(DISTINCT user_id) AS n_subjects FROM ({oracles_so_far()['clinical_sections']}) GROUP BY section")
def digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical_sections(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n_tracks"), F.countDistinct("user_id").alias("n_subjects"))


@query("burden_progression", f"{_TIMELINE} SELECT subject, min_by(day, (sld, day)) AS nadir_day, min(sld) AS nadir, max_by(sld, day) AS latest, round(max_by(sld, day) - min(sld), 6) AS from_nadir FROM r GROUP BY subject")
def burden_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day of the least sum, and how far the last sum lies above it."""
    each = timeline(series(table(spark, sf_dir, "events"))).groupBy("subject")
    out = each.agg(F.min_by("day", F.struct("sld", "day")).alias("nadir_day"), F.min("sld").alias("nadir"), F.max_by("sld", "day").alias("latest"))
    return out.select("*", F.round(F.col("latest") - F.col("nadir"), 6).alias("from_nadir"))


@query("burden_latest_call", f"""{_TIMELINE} SELECT subject, max_by(CASE WHEN baseline_sld <= 0 THEN 'NE' WHEN complete THEN 'CR' WHEN nadir_sld > 0 AND sld - nadir_sld >= {GROW_MM} AND (sld - nadir_sld) * 100 >= nadir_sld * {GROW_PCT} THEN 'PD'
  WHEN (sld - baseline_sld) * 100 <= baseline_sld * {SHRINK_PCT} THEN 'PR' ELSE 'SD' END, day) AS call FROM n GROUP BY subject""")
def burden_latest_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the last timepoint by sums alone, without new lesions."""
    t = timeline(series(table(spark, sf_dir, "events")))
    call = classify(F.col("sld"), F.col("baseline_sld"), F.col("nadir_sld"), F.lit(False), F.col("complete"))
    return t.groupBy("subject").agg(F.max_by(call, "day").alias("call"))
