"""Reports as they come: new ones, and addenda to those that are there, as versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

# items: org, patient, nth (order of arrival), note, day, kind, text. reports: org, patient, report, note, day, kind.
# versions: org, report, version, text, digest, addendum.

DEFAULT_KIND = "RR"  # fixed value: the kind of a report that names none
KEY = ["org", "patient", "note"]


def add_reports(items: DataFrame, reports: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, versions) to append for ``items``, in the order of nth; versions tell patient and nth of their item, too.

    An item whose note a patient has already, from before or earlier among the items, is an addendum: the next version of
    that report. Others are new reports with version 1, as are all without a note (null or empty). Day and kind are those of a
    report's first item. A report's id is a digest of its org, patient and note, or nth without one, so a batch that
    is run again gives the same ids; nth is unique over all batches of an org. Org and patient aren't null; a null text is empty.

    Items are numbered as narrow rows; texts are exchanged once, to meet their numbers.
    """
    named = F.nullif("note", F.lit("")).isNotNull()
    own = F.sha2(F.to_json(F.struct("org", "patient", F.when(named, F.col("note")).alias("note"), F.when(~named, F.col("nth")).alias("nth"))), 256)
    slim = items.select("org", "patient", "nth", "note", "day", F.coalesce(F.nullif("kind", F.lit("")), F.lit(DEFAULT_KIND)).alias("kind"), own.alias("own"))
    latest = versions.groupBy("org", "report").agg(F.max("version").alias("had"))
    known = reports.where(named).select(*KEY, "report").join(latest, ["org", "report"], "left")
    noted = slim.where(named).join(known, KEY, "left")
    alone = slim.where(~named).withColumns({"report": F.lit(None).cast("string"), "had": F.lit(None).cast("long")})
    place = F.row_number().over(Window.partitionBy("org", "patient", "own").orderBy("nth"))
    rows = noted.unionByName(alone).select("org", "patient", "nth", "note", "day", "kind", F.col("report").isNotNull().alias("old"), F.coalesce("report", "own").alias("report"), "had", place.alias("place"))
    rows = rows.withColumn("version", (F.coalesce("had", F.lit(0)) + F.col("place")).cast("long"))
    new = rows.where("not old and place = 1").select("org", "patient", "report", "note", "day", "kind")
    text = F.coalesce("text", F.lit(""))
    texts = items.select("org", "nth", text.alias("text"), F.sha2(text, 256).alias("digest"))
    told = rows.select("org", "patient", "nth", "report", "version", (F.col("old") | (F.col("place") > 1)).alias("addendum"))
    return new, told.join(texts, ["org", "nth"])


def with_current(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """``reports`` with the number, digest and addendum mark of their latest version, null for those without any, and ``n_versions``."""
    each = versions.groupBy("org", "report").agg(F.max_by(F.struct("version", "digest", "addendum"), "version").alias("_v"), F.count("*").alias("n_versions"))
    out = reports.join(each, ["org", "report"], "left")
    return out.select(*reports.columns, "_v.*", F.coalesce("n_versions", F.lit(0)).alias("n_versions"))


# --- the fixture: orders as items, those from 1998 on as a second batch; priorities are notes


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    note = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    items = table(spark, sf_dir, "orders").select(F.lit("org").alias("org"), F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("nth"), note.alias("note"), F.to_date("o_orderdate").alias("day"),
                                                  F.lit("").alias("kind"), F.concat_ws("-", "o_orderstatus", "o_orderkey").alias("text"))
    none = items.limit(0).withColumns({"report": F.lit(""), "version": F.lit(0).cast("long")})
    late = F.col("day") >= "1998-01-01"
    reports, versions = add_reports(items.where(~late), none, none)
    more, later = add_reports(items.where(late), reports, versions)
    return reports.unionByName(more), versions.unionByName(later)


_SQL = """WITH i AS (SELECT o_custkey AS patient, o_orderkey AS nth, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS note, CAST(o_orderdate AS DATE) AS day, o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_orderstatus || '-' || o_orderkey AS text FROM orders),
v AS (SELECT patient, note, nth, day, sha256(text) AS digest, CASE WHEN note IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY patient, note ORDER BY late, nth) END AS version FROM i)"""


@query("ingested_versions", _SQL + " SELECT patient, nth, version, version > 1 AS addendum, digest FROM v")
def ingested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir)[1].select("patient", "nth", "version", "addendum", "digest")


@query("reports_with_current", _SQL + """ SELECT patient, coalesce(note, '') AS note, arg_min(day, version) AS day, max(version) AS version, arg_max(digest, version) AS digest, count(*) AS n_versions FROM v GROUP BY patient, note, CASE WHEN note IS NULL THEN nth END""")
def reports_with_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_current(*_ingested(spark, sf_dir)).select("patient", F.coalesce("note", F.lit("")).alias("note"), "day", "version", "digest", "n_versions")
