"""Operators of review and incremental runs: sections, issues, constraint violations, plans of identities, responses and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.summaries import rate
from strandline.registry import query
from strandline.sources.tables import table

#: Certainty under which a fact is an issue, the day on which the newer run starts, measurable size, the bar of specificity, size from which events count.
LEAST_CERTAIN, NEW_RUN, MEASURABLE, SPECIFIC = 0.6, "1998-01-01", 10.0, 0.4


def section(unresolved: Column, status: Column, change: Column) -> Column:
    """The section of a track: unresolved first, then an active one by its change, then resolved and absent ones."""
    active = F.when(change == "worsening", "needs_attention").when(change == "improving", "resolved").otherwise("stable")
    found = F.when(unresolved, "uncertain").when(status == "active", active)
    return found.when(status == "resolved", "resolved").when(status == "absent", "routine_negatives").otherwise("uncertain")


def identity_plan(missing: Column, ambiguous: Column, split: Column, moved: Column, gained: Column) -> Column:
    """What becomes of a confirmed identity in a new run, with the reason; the first that holds decides."""
    return (
        F.when(missing, "reopen:missing_member").when(ambiguous, "reopen:newly_ambiguous").when(split, "reopen:newly_split")
        .when(moved & gained, "reopen:category_moved").when(gained, "acknowledge:gained_evidence").otherwise("carry")
    )


def violations(rows: DataFrame, known: DataFrame, key: str, ref: str, name: str) -> DataFrame:
    """Rows whose reference is not null and not known."""
    return rows.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col(key), "left_anti").groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many keys stand in more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


@query("clinical_sections", """WITH r AS (SELECT user_id, event_type, event_id, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events WHERE value IS NOT NULL),
t AS (SELECT user_id, event_type, count(*) = 1 AS unresolved, max_by(value >= 100, (ts, event_id)) AS last, bool_or(value >= 100) AS ever,
  max_by(CASE WHEN before = 0 OR before IS NULL THEN 'none' WHEN value / before > 1.1 THEN 'worsening' WHEN value / before < 0.9 THEN 'improving' ELSE 'stable' END, (ts, event_id)) AS change FROM r GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN unresolved THEN 'uncertain' WHEN last THEN CASE change WHEN 'worsening' THEN 'needs_attention' WHEN 'improving' THEN 'resolved' ELSE 'stable' END
  WHEN ever THEN 'resolved' ELSE 'routine_negatives' END AS section FROM t""")
def clinical_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").where("value is not null").select(*keys, "ts", "event_id", "value", before.alias("before"))
    ratio = F.try_divide(F.col("value"), F.col("before"))
    change = F.when(ratio.isNull(), "none").when(ratio > 1.1, "worsening").when(ratio < 0.9, "improving").otherwise("stable")
    at, present = F.struct("ts", "event_id"), F.col("value") >= 100
    each = rows.groupBy(*keys).agg((F.count("*") == 1).alias("unresolved"), F.max_by(present, at).alias("last"), F.bool_or(present).alias("ever"), F.max_by(change, at).alias("change"))
    status = F.when(F.col("last"), "active").when(F.col("ever"), "resolved").otherwise("absent")
    return each.select(*keys, section(F.col("unresolved"), status, F.col("change")).alias("section"))


@query("identity_plans", f"""WITH r AS (SELECT o_custkey, count(*) FILTER (NOT late) AS n_old, count(*) FILTER (late) AS n_new, bool_or(late AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS p_new, bool_or(NOT late AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS p_old,
  count(DISTINCT o_orderpriority) FILTER (late) AS k_new, count(DISTINCT o_orderpriority) FILTER (NOT late) AS k_old, max(o_totalprice) FILTER (late) > max(o_totalprice) FILTER (NOT late) AS moved
  FROM (SELECT *, o_orderdate >= TIMESTAMP '{NEW_RUN}' AS late FROM orders) GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n_new = 0 THEN 'reopen:missing_member' WHEN p_new AND NOT p_old THEN 'reopen:newly_ambiguous' WHEN k_new = 5 AND k_old < 5 THEN 'reopen:newly_split' WHEN moved AND n_new > n_old THEN 'reopen:category_moved'
  WHEN n_new > n_old THEN 'acknowledge:gained_evidence' ELSE 'carry' END AS plan FROM r WHERE n_old > 0""")
def identity_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs are folded in one grouping; an identity that was ambiguous or split before is not reopened for it."""
    late = F.col("o_orderdate") >= F.lit(NEW_RUN).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", late.alias("late"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("unsure"))
    new, old = F.col("late"), ~F.col("late")
    kinds = lambda run: F.size(F.collect_set(F.when(run, F.col("o_orderpriority"))))
    top = lambda run: F.max(F.when(run, F.col("o_totalprice")))
    r = rows.groupBy("o_custkey").agg(
        F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"), F.bool_or(new & F.col("unsure")).alias("p_new"), F.bool_or(old & F.col("unsure")).alias("p_old"),
        kinds(new).alias("k_new"), kinds(old).alias("k_old"), (top(new) > top(old)).alias("moved"),
    )
    plan = identity_plan(F.col("n_new") == 0, F.col("p_new") & ~F.col("p_old"), (F.col("k_new") == 5) & (F.col("k_old") < 5), F.col("moved"), F.col("n_new") > F.col("n_old"))
    return r.where("n_old > 0").select("o_custkey", plan.alias("plan"))


@query("new_track_keys", f"""SELECT o_custkey, o_orderpriority, o_custkey || '|' || o_orderpriority AS track_key FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_custkey, o_orderpriority HAVING min(o_orderdate) >= TIMESTAMP '{NEW_RUN}'""")
def new_track_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the newer run that the older lacks: the first date of a key decides, so no anti-join is needed."""
    first = table(spark, sf_dir, "orders").where("o_orderpriority is not null").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("first"))
    return first.where(F.col("first") >= F.lit(NEW_RUN).cast("timestamp_ntz")).select("o_custkey", "o_orderpriority", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("track_key"))


@query("constraint_violations", """SELECT 'orders.customer' AS rule, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'lineitem.key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'orders.status', count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references, repeated keys and values outside their set, counted by rule."""
    t = lambda name: table(spark, sf_dir, name)
    odd = t("orders").agg(F.count_if(F.col("o_orderstatus").isNull() | ~F.col("o_orderstatus").isin("O", "F")).alias("n")).select(F.lit("orders.status").alias("rule"), "n")
    found = [
        violations(t("orders").select("o_custkey"), t("customer").select("c_custkey"), "c_custkey", "o_custkey", "orders.customer"),
        violations(t("lineitem").select("l_orderkey"), t("orders").select("o_orderkey"), "o_orderkey", "l_orderkey", "lineitem.order"),
        violations(t("labels").select("doc_id"), t("documents").select(F.col("doc_id").alias("known_id")), "known_id", "doc_id", "labels.document"),
        repeated(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "lineitem.key"),
    ]
    for more in found:
        odd = odd.unionByName(more)
    return odd


@query("completeness_issues", """SELECT event_id, field, CASE WHEN field IN ('user_id', 'ts') THEN 'critical' ELSE 'moderate' END AS severity FROM (
  SELECT event_id, unnest(['user_id', 'ts', 'event_type', 'value', 'k']) AS field, unnest([user_id IS NULL, ts IS NULL, coalesce(event_type, '') = '', value IS NULL, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) < 10]) AS bad FROM events) WHERE bad""")
def completeness_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each required field that a row lacks; a stated k under 10 counts as missing."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)) < 10
    bad = {"user_id": F.col("user_id").isNull(), "ts": F.col("ts").isNull(), "event_type": F.coalesce("event_type", F.lit("")) == "", "value": F.col("value").isNull(), "k": k}
    fields = F.array_compact(F.array(*(F.when(b, F.lit(name)) for name, b in bad.items())))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(fields).alias("field"))
    return rows.select("event_id", "field", F.when(F.col("field").isin("user_id", "ts"), "critical").otherwise("moderate").alias("severity"))


@query("confidence_verdict", f"""SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_quantity / 50 < {LEAST_CERTAIN}) AS failed, greatest(count(*) - count(*) FILTER (l_quantity / 50 < {LEAST_CERTAIN}), 0) AS passed,
  CASE WHEN bool_or(l_quantity / 50 < {LEAST_CERTAIN}) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def confidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report fails if any fact's certainty is under the bar."""
    low = F.count_if(F.col("l_quantity") / 50 < LEAST_CERTAIN)
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), low.alias("failed"))
    return each.select("l_orderkey", "total", "failed", F.greatest(F.col("total") - F.col("failed"), F.lit(0)).alias("passed"), F.when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("verdict"))


@query("group_kappa", """WITH p AS (SELECT lang AS g, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
c AS (SELECT g, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) AS pa, avg(b) AS pb FROM p GROUP BY g)
SELECT g, n AS n_items, round(po, 6) AS po, round(CASE WHEN 1 - (pa * pb + (1 - pa) * (1 - pb)) <= 1e-12 THEN NULL ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM c""")
def group_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of two raters with labels 0 and 1 in each group, from means alone; null where chance agreement is full."""
    both = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("g")), "doc_id")
    c = both.groupBy("g").agg(F.count("*").alias("n_items"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("po"), F.avg("quality").alias("pa"), F.avg("toxic").alias("pb"))
    c = c.withColumn("pe", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    kappa = F.when(1 - F.col("pe") > 1e-12, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6))
    return c.select("g", "n_items", F.round("po", 6).alias("po"), kappa.alias("kappa"))


@query("sampling_strata", """SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 'hard' WHEN l_quantity / 50 < 0.3 THEN 'low_confidence' ELSE 'standard' END AS stratum FROM lineitem) GROUP BY stratum""")
def sampling_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by stratum: hard ones first, then uncertain ones."""
    hard = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)
    name = F.when(hard, "hard").when(F.col("l_quantity") / 50 < 0.3, "low_confidence").otherwise("standard")
    return table(spark, sf_dir, "lineitem").groupBy(name.alias("stratum")).agg(F.count("*").alias("n"))


@query("track_response", """WITH r AS (SELECT user_id, event_type, min_by(value, (ts, event_id)) AS baseline, max_by(value, (ts, event_id)) AS latest, min(value) AS nadir, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, baseline, latest, nadir, n, round((latest - baseline) / nullif(baseline, 0) * 100, 2) AS from_baseline, round((latest - nadir) / nullif(nadir, 0) * 100, 2) AS from_nadir FROM r""")
def track_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and least measurement of a track and the change from each, in one aggregation without a sort."""
    at = F.struct("ts", "event_id")
    r = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type")
    r = r.agg(F.min_by("value", at).alias("baseline"), F.max_by("value", at).alias("latest"), F.min("value").alias("nadir"), F.count("*").alias("n"))
    change = lambda of: F.round(F.try_divide(F.col("latest") - F.col(of), F.col(of)) * 100, 2)
    return r.select("*", change("baseline").alias("from_baseline"), change("nadir").alias("from_nadir"))


@query("certainty_transitions", """SELECT user_id, event_id, CASE WHEN now AND NOT before THEN 'confirmed' WHEN before AND NOT now THEN 'withdrawn' END AS transition FROM (
  SELECT user_id, event_id, value >= 150 AS now, lag(value >= 150) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE value IS NOT NULL) WHERE now <> before""")
def certainty_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where consecutive events cross the bar of certainty."""
    before = F.lag("now").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").where("value is not null").select("user_id", "ts", "event_id", (F.col("value") >= 150).alias("now")).withColumn("before", before)
    return rows.where("now <> before").select("user_id", "event_id", F.when(F.col("now"), "confirmed").otherwise("withdrawn").alias("transition"))


@query("eligibility", f"""SELECT user_id, CASE WHEN NOT bool_or(event_type = 'error') THEN 'not_applicable' WHEN count(DISTINCT event_type) FILTER (value >= {MEASURABLE}) > 0 THEN 'eligible' ELSE 'non_measurable' END AS eligible,
  count(DISTINCT event_type) FILTER (value >= {MEASURABLE}) AS n_measurable FROM events GROUP BY user_id""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a subject has the signal at all and an entity of measurable size."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.coalesce(F.max("value") >= MEASURABLE, F.lit(False)).alias("big"))
    out = each.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("signal"), F.count_if(F.col("big") & F.col("event_type").isNotNull()).alias("n_measurable"))
    state = F.when(~F.col("signal"), "not_applicable").when(F.col("n_measurable") > 0, "eligible").otherwise("non_measurable")
    return out.select("user_id", state.alias("eligible"), "n_measurable")


@query("review_throughput", """SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_subjects, count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS n_corrections,
  coalesce(round(count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') / nullif(count(*), 0), 4), 0.0) AS correction_rate, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS units FROM orders""")
def review_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done, subjects and corrections; a null in a slot is no correction."""
    corrected = F.count_if((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"))
    units = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_subjects"), corrected.alias("n_corrections"), rate(corrected, F.count("*"), 4).alias("correction_rate"), units.alias("units"))


@query("natural_order", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT), 1000000000), c_name, c_custkey) AS place FROM customer""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the number at the end of a name; names without one come last."""
    number = F.coalesce(F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("bigint"), F.lit(1000000000))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(number, "c_name", "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", place.cast("long").alias("place"))


@query("label_specificity", f"""SELECT p_partkey, round(len(string_split(p_type, ' ')) / greatest(len(string_split(p_name, ' ')), 1), 4) AS ratio, len(string_split(p_type, ' ')) / greatest(len(string_split(p_name, ' ')), 1) >= {SPECIFIC} AS specific FROM part""")
def label_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label needs at least SPECIFIC times as many tokens as the surface it names."""
    ratio = F.size(F.split("p_type", " ")) / F.greatest(F.size(F.split("p_name", " ")), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ratio, 4).alias("ratio"), (ratio >= SPECIFIC).alias("specific"))
