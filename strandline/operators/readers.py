"""Operators over labels of readers and sets of keys: confusion, bands, worklists, strata, coverage and set changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

#: Upper bounds of the bands of agreement, in order.
BANDS = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))
TOP_BAND = "almost perfect"
SEED = "17"


def band(kappa: Column) -> Column:
    """The band of agreement of a kappa; null for null."""
    found = F.when(kappa.isNull(), None)
    for bound, name in BANDS:
        found = found.when(kappa < bound, name)
    return found.otherwise(TOP_BAND)


def stratified(rows: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """The first round(share * n) keys of each stratum in the order of a seeded hash; a rerun picks the same."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(SEED + ":"), F.col(key).cast("string"))), key)
    whole = F.count("*").over(Window.partitionBy(stratum))
    return rows.withColumn("_n", F.row_number().over(order)).withColumn("_whole", whole).where(F.col("_n") <= F.round(F.col("_whole") * share)).drop("_n", "_whole")


@query("confusion_matrix", "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    return both.groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n"))


@query("agreement_bands", """SELECT n_name, rate, CASE WHEN rate < 0.0 THEN 'poor' WHEN rate < 0.2 THEN 'slight' WHEN rate < 0.4 THEN 'fair' WHEN rate < 0.6 THEN 'moderate'
  WHEN rate < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM (
    SELECT n_name, round(count(*) FILTER (c_acctbal >= 4000) / count(*), 4) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)""")
def agreement_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.count_if(F.col("c_acctbal") >= 4000) / F.count("*"), 4).alias("rate"))
    named = rates.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "rate", band(F.col("rate")).alias("band"))


@query("disagreement_worklist", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def disagreement_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("not (quality <=> toxic)").select("doc_id", "quality", "toxic")


@query("latest_label", """SELECT user_id AS item, max_by(event_type, (ts, event_id)) AS label, count(*) AS n_labels FROM events GROUP BY user_id""")
def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label given last stands; equal times are told apart by id."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"), F.count("*").alias("n_labels"))


@query("stratified_pick", f"""SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('{SEED}:' || c_custkey), c_custkey) AS n,
  count(*) OVER (PARTITION BY c_mktsegment) AS whole FROM customer) WHERE n <= round(whole * 0.1)""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.1).select("c_mktsegment", "c_custkey")


@query("composite_key_flags", """SELECT l_orderkey, l_linenumber, coalesce(flagged, false) AS flagged FROM lineitem
  LEFT JOIN (SELECT o_orderkey, true AS flagged FROM orders WHERE o_orderpriority = '1-URGENT') ON o_orderkey = l_orderkey""")
def composite_key_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(True).alias("flagged"))
    out = table(spark, sf_dir, "lineitem").join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("nearby_pairs", """SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line, round(1 - abs(a.l_quantity - b.l_quantity) / 10, 4) AS strength
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.l_quantity - b.l_quantity) <= 10""")
def nearby_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one report at most a distance apart; reports hold few events, the distance is a residual of the hashed join."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("left_line"), F.col("l_quantity").alias("x"))
    right = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("right_line"), F.col("l_quantity").alias("y"))
    apart = F.abs(F.col("x") - F.col("y"))
    return left.join(right, "l_orderkey").where((F.col("left_line") < F.col("right_line")) & (apart <= 10)).select("l_orderkey", "left_line", "right_line", F.round(1 - apart / 10, 4).alias("strength"))


@query("confirmed_across_sources", """SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT l_suppkey) FILTER (l_discount >= 0.05) AS n_sure, count(DISTINCT l_suppkey) FILTER (l_discount >= 0.05) >= 2 AS confirmed
  FROM lineitem GROUP BY l_partkey""")
def confirmed_across_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed where two sources are sure. Rows are reduced to one per (key, source) before they are counted."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_discount") >= 0.05).alias("sure"))
    sure = F.count_if("sure")
    return each.groupBy("l_partkey").agg(F.count("l_suppkey").alias("n_sources"), sure.alias("n_sure"), (sure >= 2).alias("confirmed"))


@query("evidence_changes", """WITH r AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O')), []) AS now, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')), []) AS before FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_filter(now, lambda x: NOT list_contains(before, x)), ';') AS gained, array_to_string(list_filter(before, lambda x: NOT list_contains(now, x)), ';') AS lost, now = before AS unchanged,
  CASE WHEN len(now) + len(before) = 0 THEN 0.0 ELSE round(len(list_intersect(now, before)) / len(list_distinct(list_concat(now, before))), 4) END AS jaccard FROM r""")
def evidence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key what the newer set gained over the older and lost from it, whether both are equal, and their Jaccard similarity."""
    kinds = lambda status: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority"))))
    r = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(kinds("O").alias("now"), kinds("F").alias("before"))
    jaccard = F.coalesce(F.round(F.try_divide(F.size(F.array_intersect("now", "before")), F.size(F.array_union("now", "before"))), 4), F.lit(0.0))
    gained, lost = F.array_join(F.array_except("now", "before"), ";"), F.array_join(F.array_except("before", "now"), ";")
    return r.select("o_custkey", gained.alias("gained"), lost.alias("lost"), (F.col("now") == F.col("before")).alias("unchanged"), jaccard.alias("jaccard"))


@query("ordered_dedupe", """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each combination: min is enough where only the place is kept, so partial sums run before the shuffle."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.min("l_linenumber").alias("l_linenumber")).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("unique_event_ids", """SELECT event_id, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS unique_name FROM (SELECT event_id, event_type || '-' || user_id AS name, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)""")
def unique_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal names keeps it, later ones get _2, _3 and on."""
    rows = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null")
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    rows = rows.select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"), n.alias("n"))
    return rows.select("event_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n").cast("string"))).alias("unique_name"))


@query("certainty_scores", """SELECT event_id, CASE WHEN k IS NULL THEN 0.5 WHEN k > 1 AND k <= 100 THEN round(k / 100.0, 4) ELSE greatest(0.0, least(1.0, CAST(k AS DOUBLE))) END AS certainty
  FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def certainty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated certainty as a share: percentages are divided, the rest is clamped, 0.5 where none is stated."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    score = F.when(k.isNull(), 0.5).when((k > 1) & (k <= 100), F.round(k / 100.0, 4)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), k)))
    return table(spark, sf_dir, "events").select("event_id", score.alias("certainty"))


@query("review_timing", """SELECT o_custkey, min(o_orderdate) AS first_seen, max(l_shipdate) AS last_done, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS BIGINT) AS elapsed_days, count(l_orderkey) AS n_lines
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def review_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sight, last completion and days between. Lines are summed up per order before they meet the orders."""
    done = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"), F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = both.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("done").alias("last_done"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))
    return out.select("o_custkey", "first_seen", "last_done", F.datediff(F.to_date("last_done"), F.to_date("first_seen")).cast("long").alias("elapsed_days"), "n_lines")


@query("coverage_counts", """SELECT count(*) FILTER (a AND b) AS n_common, count(*) FILTER (a AND NOT b) AS n_only_left, count(*) FILTER (b AND NOT a) AS n_only_right FROM (
  SELECT c_custkey IS NOT NULL AS a, o_custkey IS NOT NULL AS b FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey)""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items common to two readers and those of only one: one grouping of both lists in place of three set operations."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("a"), F.lit(False).alias("b"))
    right = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit(False).alias("a"), F.lit(True).alias("b"))
    each = left.unionByName(right).groupBy("k").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return each.agg(F.count_if(F.col("a") & F.col("b")).alias("n_common"), F.count_if(F.col("a") & ~F.col("b")).alias("n_only_left"), F.count_if(F.col("b") & ~F.col("a")).alias("n_only_right"))
