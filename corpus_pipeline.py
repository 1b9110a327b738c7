"""A corpus from raw documents to shuffled shards: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Shelf, table
from strandline.llm.decontaminate import contamination
from strandline.llm.mixing import mix
from strandline.llm.sharding import shuffle_into_shards
from strandline.llm.simhash import components, group_near_duplicates
from strandline.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar predicts as toxic go."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("_toxic.predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Fingerprints within 4 bits link, as in op6; so do texts whose sets of shingles are similar, which the bits may not tell.
    Documents without an id are told apart by similarity alone.
    """
    prints = group_near_duplicates(docs.select("doc_id", "text"), width=4, budget=4).select("doc_id", F.col("_component").alias("a"))
    similar = group_near_duplicates(docs)
    roots = components(prints.join(similar.select("doc_id", F.col("_component").alias("b")), "doc_id").select("a", "b").distinct())
    kept = similar.where("_kept").join(roots, F.col("_component") == F.col("node"), "left")
    return kept.where("root is null or root = _component").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not _hit.contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents that it doesn't take go."""
    mixed = mix(docs).where("_mix.copies > 0")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies"))).alias("_mix_copy")).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard and the slot in it that they are shuffled to."""
    return shuffle_into_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: XXH64 fingerprints, fitted weights and seeded shuffles have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES:
        docs = shelf.park(stage(spark, docs, sf_dir), f"stage-{name}")
        shelf.clear(docs)  # what a stage has read goes once its own rows are written
    return docs
