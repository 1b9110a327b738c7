"""Aggregations, joins and predicates over generic columns, bound to the fixture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table


def rate(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded, 0.0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def readable(text: Column) -> Column:
    """At least five characters and two words, no comma or semicolon in front, no comma at the end."""
    t = F.btrim(text)
    return (F.length(t) >= 5) & (F.size(F.array_remove(F.split(t, " +"), "")) >= 2) & ~t.rlike("^[,;]") & ~t.rlike(",$")


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the most frequent value; of ties the longer, then the larger in lower case."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", F.length(value), F.lower(value))).alias("most_common"), F.max("n").alias("n"))


def consensus(value: Column) -> Column:
    """The value that all agree on, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def zero_filled(counts: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """A row for each class, 0 where none was counted."""
    return classes.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("kpi_overview", """SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(DISTINCT o_custkey) AS n_subjects,
  coalesce(round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 4), 0.0) AS done_rate FROM orders""")
def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), done.alias("n_done"), F.countDistinct("o_custkey").alias("n_subjects"), rate(done, F.count("*"), 4).alias("done_rate"))


@query("class_distribution", """SELECT p AS o_orderpriority, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'NE']) AS p)
  LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = 'F' GROUP BY p""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "NE")], "o_orderpriority string")
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return zero_filled(counts, classes, "o_orderpriority")


@query("reviewer_leaderboard", """SELECT s_suppkey, n_name, count(l_orderkey) AS n, count(l_orderkey) FILTER (l_returnflag = 'R') AS n_corrections,
  coalesce(round(count(l_orderkey) FILTER (l_returnflag = 'R') / nullif(count(l_orderkey), 0), 4), 0.0) AS correction_rate
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def reviewer_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are summed before they meet the reviewers, so the join moves one row for each."""
    work = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_corrections"))
    who = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = who.join(work, F.col("s_suppkey") == F.col("l_suppkey"), "left").fillna(0, ["n", "n_corrections"])
    return out.select("s_suppkey", "n_name", "n", "n_corrections", rate(F.col("n_corrections"), F.col("n"), 4).alias("correction_rate"))


@query("most_common_value", """SELECT l_suppkey, max_by(l_returnflag, (n, length(l_returnflag), lower(l_returnflag))) AS most_common, max(n) AS n
  FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL) GROUP BY l_suppkey""")
def most_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_common(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("consensus_value", "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS consensus FROM orders GROUP BY o_custkey")
def consensus_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(consensus(F.col("o_orderstatus")).alias("consensus"))


@query("telemetry_summary", """SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users, grouping_id(event_type, CAST(ts AS DATE)) AS level
  FROM events GROUP BY GROUPING SETS ((event_type), (CAST(ts AS DATE)), ())""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    sets = [[F.col("event_type")], [F.col("day")], []]
    return events.groupingSets(sets, "event_type", "day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.grouping_id("event_type", "day").alias("level"))


@query("usage_cost", """SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS units, round(sum(length(text)) / 1000000.0 * CASE WHEN role = 'assistant' THEN 4.5 ELSE 0.75 END, 6) AS cost
  FROM conversations GROUP BY role""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.sum(F.length("text"))
    price = F.when(F.col("role") == "assistant", 4.5).otherwise(0.75)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), units.alias("units")).withColumn("cost", F.round(F.col("units") / 1e6 * price, 6))


@query("readable_evidence", r"""SELECT doc_id, length(trim(text)) >= 5 AND len(list_filter(string_split_regex(trim(text), ' +'), lambda x: x <> '')) >= 2
  AND NOT regexp_matches(trim(text), '^[,;]') AND NOT regexp_matches(trim(text), ',$') AS readable FROM documents""")
def readable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", readable(F.col("text")).alias("readable"))


@query("unconfirmed_to_confirmed", """SELECT user_id, round(100.0 * count(*) FILTER (resolved) / count(*), 2) AS resolution_rate FROM (
  SELECT user_id, event_type, bool_or(value >= 400 AND n > 1) AS resolved FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL
  HAVING NOT bool_or(n = 1 AND value >= 400)) GROUP BY user_id""")
def unconfirmed_to_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of entities first seen below the bar that later reach it: the first value comes from min_by, no sort is needed."""
    sure = F.col("value") >= 400
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by(sure, F.struct("ts", "event_id")).alias("at_first"), F.bool_or(sure).alias("ever"))
    return each.where("not at_first").groupBy("user_id").agg(F.round(F.lit(100.0) * F.count_if("ever") / F.count("*"), 2).alias("resolution_rate"))


@query("latest_version", """SELECT o_custkey, o_orderkey, o_totalprice, version FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders) WHERE back = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(latest.alias("v"), F.count("*").alias("version")).select("o_custkey", "v.*", "version")


@query("member_of_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def member_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("children_counted", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def children_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("split_candidates", """SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 5""")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of one type that may be the same: each is looked up under all sizes that fit, so equal keys lead to pairs of the result or their mirror images only."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"))
    a = p.select(F.col("p_partkey").alias("left_key"), "p_brand", "p_type", F.explode(F.sequence(F.col("p_size") - 5, F.col("p_size") + 5)).alias("p_size"))
    b = p.withColumnRenamed("p_partkey", "right_key")
    return a.join(b, ["p_brand", "p_type", "p_size"]).where("left_key < right_key").select("left_key", "right_key")


@query("rater_agreement", """WITH p AS (SELECT coalesce(CAST(quality AS VARCHAR), '∅null') AS a, coalesce(CAST(toxic AS VARCHAR), '∅null') AS b FROM labels), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT sum(n) AS total FROM c), o AS (SELECT sum(n) FILTER (a = b) / any_value(total) AS po FROM c, t),
e AS (SELECT sum(x.n * y.n) / any_value(total * total) AS pe FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON a = b, t)
SELECT CAST(total AS BIGINT) AS n_items, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN 1 - pe > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM o, e, t""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


#: Fixed value: the category of a slot that a reader left blank.
BLANK = "∅null"


def category(value: Column) -> Column:
    """A label as a category: structured ones as JSON with keys in order, blank ones a category of their own."""
    return F.coalesce(value.cast("string"), F.lit(BLANK))


def kappa(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's kappa of two raters, per group of ``by``; null where chance agreement is full or there is nothing to agree on.

    Blank labels are a category. Items are counted by pair of categories first; only these counts meet.
    """
    n, by = F.sum("n"), list(by)
    cells = pairs.groupBy(*by, category(F.col(a)).alias("a"), category(F.col(b)).alias("b")).agg(F.count("*").alias("n"))
    margins = cells.select(*by, F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).alias("nb")).union(cells.select(*by, F.col("b").alias("c"), F.lit(0).alias("na"), F.col("n").alias("nb")))
    both = margins.groupBy(*by, "c").agg((F.sum("na") * F.sum("nb")).alias("chance")).select(*by, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("same"), "chance")
    rows = cells.select(*by, "n", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"), F.lit(0).cast("long").alias("chance")).union(both)
    out = rows.groupBy(*by).agg(n.alias("n_items"), (F.sum("same") / n).alias("po"), (F.sum("chance") / (n * n)).alias("pe"))
    score = F.when(1 - F.col("pe") > 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.select(*by, F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(score, 6).alias("kappa"))


@query("top_per_group", """SELECT s_nationkey, s_suppkey, s_acctbal, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").withColumn("rank", rank).where("rank <= 3").select("s_nationkey", "s_suppkey", "s_acctbal", "rank")


@query("gained_and_lost", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'gained' WHEN b.k IS NULL THEN 'lost' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def gained_and_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass instead of a full join: which of the two runs hold a key."""
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(late).alias("new"), F.bool_or(~late).alias("old"))
    return runs.select("k", F.when(~F.col("old"), "gained").when(~F.col("new"), "lost").otherwise("kept").alias("change"))


@query("report_manifest", """SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || sha256(CAST(o_orderkey AS VARCHAR) || o_orderstatus), chr(10) ORDER BY o_orderkey)) AS manifest FROM orders GROUP BY o_custkey""")
def report_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a subject's versions that doesn't depend on input order and changes with any text."""
    key = F.col("o_orderkey")
    entry = F.concat(key.cast("string"), F.lit(":"), F.sha2(F.concat(key.cast("string"), "o_orderstatus"), 256))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e")))), lambda x: x["e"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("manifest"))


@query("turn_order_gaps", """SELECT conv_id, turn, role, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS same_speaker FROM conversations""")
def turn_order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") - F.lag("turn").over(w)).alias("step"), (F.lag("role").over(w) == F.col("role")).alias("same_speaker"))
