"""Hash chains over signed rows and audit entries: written as an ordered fold per key, verified without one."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.registry import query
from strandline.sources.tables import table

GENESIS = "GENESIS"


def row_hash(previous: Column, *fields: Column) -> Column:
    """SHA-256 of the previous row's hash, or GENESIS, and the row's fields, joined by bars; a null field is empty."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit(GENESIS)), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def chained(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with ``prev_hash`` (null for the first of a key) and ``row_hash``.

    Each hash takes in the one before, so a key's rows are put in order and hashed in one pass by one task, which holds
    them: its time and memory grow with the rows of a key. Keys are independent of one another. Columns named
    ``_ch_*``, in any case, are left out.
    """
    columns = [c for c in rows.columns if c not in key and not c.lower().startswith("_ch_")]
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    placed = rows.select(*key, *columns, text.alias("_ch_text"), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_ch_at"))

    def one_pass(group):
        import pyarrow as pa

        group = group.sort_by("_ch_at")
        hashes = [None]
        for entry in group["_ch_text"].to_pylist():
            hashes.append(hashlib.sha256(f"{hashes[-1] or GENESIS}|{entry}".encode()).hexdigest())
        return pa.table([*[group[c] for c in (*key, *columns)], pa.array(hashes[:-1], pa.string()), pa.array(hashes[1:], pa.string())], names=[*key, *columns, "prev_hash", "row_hash"])

    kind = T.StructType([*[rows.schema[c] for c in (*key, *columns)], T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])
    return placed.groupBy(*key).applyInArrow(one_pass, kind)


def chain_faults(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Keys, order and ``fault`` of every row that breaks its chain.

    Linkage compares the stored previous hash with that of the row before, a fork is a previous hash that two rows
    name, and hashes are worked out from the stored previous hash: each row stands for itself and nothing is folded.
    """
    at = Window.partitionBy(*key).orderBy(*order)
    before, nth = F.lag("row_hash").over(at), F.row_number().over(at)
    named = F.row_number().over(Window.partitionBy(*key, "prev_hash").orderBy(*order))
    checks = [
        F.when((nth == 1) & F.col("prev_hash").isNotNull(), "genesis_has_previous"),
        F.when((nth > 1) & ~F.col("prev_hash").eqNullSafe(before), "broken_linkage"),
        F.when(F.col("prev_hash").isNotNull() & (named > 1), "fork"),
        F.when(~F.col("row_hash").eqNullSafe(row_hash(F.col("prev_hash"), *[F.col(f) for f in fields])), "row_hash_mismatch"),
    ]
    faults = rows.select(*key, *order, F.array_compact(F.array(*checks)).alias("faults"))
    return faults.select(*key, *order, F.explode("faults").alias("fault"))


def signed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sign-offs of a customer; the payload's own hash is one of the fields."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderdate", "o_orderkey", F.sha2(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), 256).alias("payload_sha256"), "o_orderstatus")


_SIGNED = """s AS (SELECT o_custkey, o_orderdate, o_orderkey, sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS payload_sha256, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"""
_CHAIN = """c AS (
  SELECT o_custkey, o_orderdate, o_orderkey, payload_sha256, o_orderstatus, k, CAST(NULL AS VARCHAR) AS prev_hash, sha256('GENESIS|' || payload_sha256 || '|' || o_orderkey || '|' || o_orderstatus) AS row_hash FROM s WHERE k = 1
  UNION ALL SELECT s.o_custkey, s.o_orderdate, s.o_orderkey, s.payload_sha256, s.o_orderstatus, s.k, c.row_hash, sha256(c.row_hash || '|' || s.payload_sha256 || '|' || s.o_orderkey || '|' || s.o_orderstatus)
  FROM c JOIN s ON s.o_custkey = c.o_custkey AND s.k = c.k + 1)"""
_FIELDS = ["payload_sha256", "o_orderkey", "o_orderstatus"]


@query("signoff_chain", f"WITH RECURSIVE {_SIGNED}, {_CHAIN} SELECT o_custkey, o_orderkey, payload_sha256, prev_hash, row_hash FROM c")
def signoff_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chained(signed_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], _FIELDS)
    return out.select("o_custkey", "o_orderkey", "payload_sha256", "prev_hash", "row_hash")


_BAD = """b AS (SELECT o_custkey, o_orderdate, o_orderkey, payload_sha256, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE prev_hash END AS prev_hash, row_hash, k FROM c),
w AS (SELECT *, lag(row_hash) OVER (PARTITION BY o_custkey ORDER BY k) AS before, row_number() OVER (PARTITION BY o_custkey, prev_hash ORDER BY k) AS named FROM b)"""


@query("signoff_chain_faults", f"""WITH RECURSIVE {_SIGNED}, {_CHAIN}, {_BAD}
SELECT o_custkey, o_orderkey, unnest(list_filter([CASE WHEN k = 1 AND prev_hash IS NOT NULL THEN 'genesis_has_previous' END, CASE WHEN k > 1 AND prev_hash IS DISTINCT FROM before THEN 'broken_linkage' END,
  CASE WHEN prev_hash IS NOT NULL AND named > 1 THEN 'fork' END, CASE WHEN row_hash <> sha256(coalesce(prev_hash, 'GENESIS') || '|' || payload_sha256 || '|' || o_orderkey || '|' || o_orderstatus) THEN 'row_hash_mismatch' END], lambda x: x IS NOT NULL)) AS fault FROM w""")
def signoff_chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of ``signoff_chain`` with some rows changed and some links lost after it was written."""
    rows = chained(signed_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], _FIELDS)
    key = F.col("o_orderkey")
    bad = rows.withColumn("o_orderstatus", F.when(key % 17 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("prev_hash", F.when(key % 13 != 0, F.col("prev_hash")))
    return chain_faults(bad, ["o_custkey"], ["o_orderdate", "o_orderkey"], _FIELDS).select("o_custkey", "o_orderkey", "fault")
