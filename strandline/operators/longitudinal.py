"""Operators over ordered series: as-of lookups, status folds, edges between events, sessions, rolling counts and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

#: Change of a measurement that counts, seconds of the rolling window, gap and words of a segment.
WORSE, BETTER = 1.10, 0.90
ROLLING_S, GAP_S, MOST_IN_SEGMENT = 60, 3600, 20


def as_of(asked: DataFrame, known: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``asked`` with the last ``value`` of ``known`` at or before its time, null if none.

    Both sides are one stream per key, so one shuffle and one pass replace a range join. At equal times known rows stand first.
    """
    own = [F.col(c) for c in asked.columns if c not in (key, at)]
    a = asked.select(key, at, F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(known.schema[value].dataType).alias("_value"))
    k = known.where(F.col(value).isNotNull()).select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    before = Window.partitionBy(key).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(k).withColumn("_value", F.last("_value", ignorenulls=True).over(before))
    return both.where("_side = 1").select(key, at, "_row.*", F.col("_value").alias(value))


def change_label(now: Column, before: Column) -> Column:
    """worsening, improving or stable by the ratio of two measurements; null without both."""
    ratio = F.try_divide(now, before)
    return F.when(ratio > WORSE, "worsening").when(ratio < BETTER, "improving").when(ratio.isNotNull(), "stable")


def edges(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """An edge from each event of a track to the next, labelled by the change of its measurement."""
    w = Window.partitionBy(*keys).orderBy(*order)
    key = order[-1]
    out = events.select(*keys, F.col(key).alias("from_id"), F.lead(key).over(w).alias("to_id"), change_label(F.lead(value).over(w), F.col(value)).alias("change"))
    return out.where("to_id is not null")


def segments(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """Events cut into segments: where the gap is over GAP_S seconds, and after each MOST_IN_SEGMENT events without one."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at)) > GAP_S
    run = events.select(key, at, order, F.when(gap, 1).otherwise(0).alias("_cut"))
    run = run.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(at, order)) - 1
    run = run.withColumn("_part", F.floor(place / MOST_IN_SEGMENT))
    return run.groupBy(key, "_run", "_part").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_run", "_part")


@query("asof_lookup", """SELECT o.o_custkey AS user_id, o.o_orderkey, o.o_orderdate AS ts, e.value FROM orders o
  ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return as_of(asked, table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value").select("user_id", "o_orderkey", "ts", "value")


@query("progression_edges", f"""SELECT user_id, event_type, from_id, to_id, CASE WHEN later / nullif(value, 0) > {WORSE} THEN 'worsening' WHEN later / nullif(value, 0) < {BETTER} THEN 'improving'
  WHEN later / nullif(value, 0) IS NOT NULL THEN 'stable' END AS change FROM (
    SELECT user_id, event_type, value, event_id AS from_id, lead(event_id) OVER w AS to_id, lead(value) OVER w AS later FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE to_id IS NOT NULL""")
def progression_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("coevolution", f"""WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
l AS (SELECT user_id, event_type, day, v / nullif(lag(v) OVER (PARTITION BY user_id, event_type ORDER BY day), 0) AS r FROM e),
c AS (SELECT user_id, event_type, day, CASE WHEN r > {WORSE} THEN 'worsening' WHEN r < {BETTER} THEN 'improving' ELSE 'stable' END AS change FROM l WHERE r IS NOT NULL)
SELECT a.user_id, a.event_type AS left_type, b.event_type AS right_type, count(*) AS shared, round(count(*) FILTER (a.change = b.change) / count(*), 4) AS strength
FROM c a JOIN c b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 2""")
def coevolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of one subject that change in the same intervals: tracks meet by subject and day, where each has one row, so pairs stay few."""
    day = table(spark, sf_dir, "events").where("value is not null and ts is not null").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    w = Window.partitionBy("user_id", "event_type").orderBy("day")
    c = day.select("user_id", "event_type", "day", change_label(F.col("v"), F.lag("v").over(w)).alias("change")).where("change is not null")
    b = c.select("user_id", "day", F.col("event_type").alias("right_type"), F.col("change").alias("right_change"))
    both = c.withColumnRenamed("event_type", "left_type").join(b, ["user_id", "day"]).where("left_type < right_type")
    out = both.groupBy("user_id", "left_type", "right_type").agg(F.count("*").alias("shared"), F.count_if(F.col("change") == F.col("right_change")).alias("same"))
    return out.where("shared >= 2").select("user_id", "left_type", "right_type", "shared", F.round(F.col("same") / F.col("shared"), 4).alias("strength"))


@query("latest_status", """WITH r AS (SELECT user_id, event_type, value >= 100 AS present, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE value IS NOT NULL)
SELECT user_id, event_type, CASE WHEN bool_or(back = 1 AND present) THEN 'active' WHEN bool_or(back > 1 AND present) THEN 'resolved' ELSE 'absent' END AS status, count(*) AS n_events FROM r GROUP BY ALL""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assertion decides, absent after any present is resolved: one aggregation, no sort of the track."""
    present = F.col("value") >= 100
    each = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type")
    each = each.agg(F.max_by(present, F.struct("ts", "event_id")).alias("last"), F.bool_or(present).alias("ever"), F.count("*").alias("n_events"))
    return each.select("user_id", "event_type", F.when(F.col("last"), "active").when(F.col("ever"), "resolved").otherwise("absent").alias("status"), "n_events")


@query("track_summary", """SELECT user_id, count(*) AS event_count, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS kinds, max_by(event_type, (ts, event_id)) AS latest_type,
  min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(*) FILTER (event_type = 'purchase') AS n_purchases FROM events GROUP BY user_id""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the latest event, spans and distinct kinds of a track in one pass."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    day = F.to_date("ts")
    out = table(spark, sf_dir, "events").groupBy("user_id")
    return out.agg(F.count("*").alias("event_count"), kinds.alias("kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))


@query("activity_segments", f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) >= {(GAP_S + 1) * 1_000_000} THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // {MOST_IN_SEGMENT} AS part FROM r)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM p GROUP BY user_id, run, part""")
def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("rolling_starts", f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN {ROLLING_S - 1} PRECEDING AND CURRENT ROW) AS n_starts FROM events""")
def rolling_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of a key in the ROLLING_S seconds that end with each start."""
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("second").rangeBetween(-(ROLLING_S - 1), 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", second.alias("second")).select("event_id", F.count("*").over(w).alias("n_starts"))


@query("chain_head", """SELECT o_custkey, list_reduce(list_prepend('', list(sha256(o_orderkey || '|' || o_orderstatus) ORDER BY o_orderkey)), lambda a, b: sha256(a || b)) AS head, count(*) AS n
  FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey""")
def chain_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head of each key's hash chain: row hash = sha256(previous row hash + payload hash). A chain is a fold, so a key's payload hashes meet in one row."""
    payload = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256)
    chain = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("seq"), payload.alias("payload"))))
    head = F.aggregate(chain, F.lit(""), lambda prev, x: F.sha2(F.concat(prev, x["payload"]), 256))
    return table(spark, sf_dir, "orders").where("o_orderstatus is not null").groupBy("o_custkey").agg(head.alias("head"), F.count("*").alias("n"))


@query("chain_linkage", """WITH s AS (SELECT o_custkey, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS row_hash, lag(sha256(CAST(o_orderkey AS VARCHAR))) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
t AS (SELECT o_custkey, o_orderkey, row_hash, CASE WHEN o_orderkey % 7 = 0 THEN row_hash ELSE prev END AS stored FROM s)
SELECT o_custkey, o_orderkey, stored IS NOT DISTINCT FROM lag(row_hash) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS linked FROM t""")
def chain_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each stored previous hash is that of the row before (null for the first). Orders divisible by 7 stand for tampered rows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("row_hash"))
    before = F.lag("row_hash").over(w)
    stored = F.when(F.col("o_orderkey") % 7 == 0, F.col("row_hash")).otherwise(before)
    return rows.select("o_custkey", "o_orderkey", stored.eqNullSafe(before).alias("linked"))


@query("sequence_verifier", """SELECT conv_id, count(*) AS n, count(*) - count(DISTINCT turn) AS n_duplicates, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS n_missing,
  count(*) FILTER (role IS NULL OR text IS NULL OR text = '') AS n_bad FROM conversations GROUP BY conv_id""")
def sequence_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate, missing and empty entries of each sequence."""
    distinct = F.countDistinct("turn")
    bad = F.count_if(F.col("role").isNull() | F.col("text").isNull() | (F.col("text") == ""))
    missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct, F.lit(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), (F.count("*") - distinct).alias("n_duplicates"), missing.alias("n_missing"), bad.alias("n_bad"))
