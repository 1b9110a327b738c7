"""Sharding by a two-pass external shuffle: seeded hashes scatter rows into memory-sized buckets, Fisher-Yates shuffles each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import other_columns, table

SEED = 20240117


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the highest seeded hash of (key, shard). One more shard only takes rows into itself."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("h"), s.alias("s")))
    return F.array_max(ranked)["s"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = list(range(n))
    if n > 1:
        for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int = 40, bucket_bytes: int = 4 << 20, seed: int = SEED) -> DataFrame:
    """``docs`` with int ``shard``, long ``slot`` (gapless from 0 in its shard) and int ``grown_shard``, under the law ``key``.

    First pass: the shard follows from doc_id and the shard count alone; inside it a seeded hash of id and
    text scatters rows uniformly into as many buckets as keep each near ``bucket_bytes`` (counted over all
    rows). Second pass: each bucket is put in hash order, so that arrival order does not matter, and
    shuffled by Fisher-Yates with a generator seeded by (seed, shard, bucket). Buckets follow one another,
    so slot = rows of earlier buckets + place. The text is shuffled once; bucket offsets meet it in the
    same exchange by a cogroup.

    Nulls: a null text counts as empty; rows with a null id share one shard but spread over its buckets.
    Repeated rows get different slots; rows equal in every column share a bucket. An empty table gives no rows.
    Columns named shard, slot, grown_shard or ``_sh_*`` of the input, in any case, are replaced.
    """
    own = other_columns(docs, "shard", "slot", "grown_shard", prefix="_sh_")
    spark = docs.sparkSession
    placed = docs.select(*own, shard_of(F.col("doc_id"), shards, seed).alias("shard"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_sh_mix"))
    heaviest = placed.groupBy("shard").agg(F.sum(row_size()).alias("b")).agg(F.max("b")).first()[0] or 0
    per_shard = max(1, -(-int(heaviest) // bucket_bytes))
    placed = placed.withColumn("_sh_bucket", F.pmod(F.shiftright("_sh_mix", 13), F.lit(per_shard)).cast("int"))
    counts = placed.groupBy("shard", "_sh_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sh_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    grown = shard_of(F.col("doc_id"), shards + 1, seed)
    rows = placed.select(*own, "shard", "_sh_bucket", grown.alias("grown_shard"), F.xxhash64(*[F.col(c) for c in own if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]).alias("_sh_row"))
    out = T.StructType([*[docs.schema[c] for c in own], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])

    def second_pass(left, right):
        import pyarrow as pa

        n = left.num_rows
        if n:
            shard, bucket = left["shard"][0].as_py(), left["_sh_bucket"][0].as_py()
            order = np.argsort(left["_sh_row"].to_numpy(), kind="stable")
            left = left.drop(["_sh_bucket", "_sh_row"]).take(order[fisher_yates(n, np.random.default_rng([seed, shard, bucket]))])
        offset = right["offset"][0].as_py() if right.num_rows else 0
        slot = pa.array(np.arange(n, dtype=np.int64) + offset)
        return pa.table([*[left[c] for c in own], left["shard"], slot, left["grown_shard"]], names=[*own, "shard", "slot", "grown_shard"])

    keys = ("shard", "_sh_bucket")
    return rows.groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInArrow(second_pass, out)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard's rows in slot order below ``path/shard=N``."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", row_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
