"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, other_columns, park, table

SEED = "mix-1"
BLANKS, GAP = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, GAP))).otherwise(0).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A weight from 0.5 to 2: texts whose mean word is near five characters weigh most."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.lit(1.5) / (F.lit(1.0) + F.abs(F.coalesce(mean, F.lit(0.0)) - F.lit(5.0)))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    most_epochs: int = 2,
    quality: Column | None = None,
    buckets: int = 1024,
    seed: str = SEED,
    broadcast_sources: int = 10_000,
) -> DataFrame:
    """``docs`` with a struct column ``_mix`` (size, source_size, target, taken, copies).

    * Sources in code point order (null last) get ``weights`` in turn and share ``budget`` times all words.
      No target passes ``most_epochs`` times its source's words; the excess goes to the others by weight
      (water filling: sources sorted by cap over weight, one row per source).
    * A document's exponential key is ``-ln(u) / quality``, u from an md5 of seed, id and text, so reruns agree.
      Complete epochs take every document; the remaining words are filled in key order. The document at
      the boundary is taken in part (``taken`` words), so a source's words equal its target rounded down.
    * ``copies``: whole rows that the mix emits; the boundary document counts if at least half is taken.

    Scale: the key order is never sorted as a whole. Rows are summed into ``buckets`` key ranges per source
    (map-side combined), a prefix over these sums finds the range in which the budget ends, and only that
    range is sorted. A source with a third of all rows is thus spread over all tasks. The plan has one short row
    per source; up to ``broadcast_sources`` of them are broadcast, so texts don't move to meet their source.

    Nulls: a null or empty text has size 0 and takes nothing; a null source is a source; a null id hashes as
    empty. Rows with the same key (repeated rows) share the boundary in proportion to their sizes. An empty
    table gives no rows. A column named ``_mix`` or ``_mix_*`` of the input is replaced.
    """
    own = other_columns(docs, "_mix", prefix="_mix_")
    size = word_count(F.col("text"))
    quality = quality if quality is not None else quality_weight(F.col("text"), size)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    fed = docs.select(*own, size.alias("_mix_size"), (-F.log(u) / quality).alias("_mix_key"))
    narrow = park(fed.select("source", "_mix_size", "_mix_key", F.floor(F.lit(buckets) * (1 - F.exp(-F.col("_mix_key")))).alias("_mix_bucket")), "mix")

    sums = narrow.groupBy("source", "_mix_bucket").agg(F.sum("_mix_size").alias("words"))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most_epochs)
    cuts = _cuts(narrow, sums, plan)
    plan = plan.join(cuts, plan.source.eqNullSafe(cuts.cut_source), "left").drop("cut_source")
    plan = park(plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns if c != "left"]), "plan")
    if plan.count() <= broadcast_sources:
        plan = F.broadcast(plan)

    out = fed.join(plan, fed.source.eqNullSafe(plan._mix_source), "left")
    key, own_size = F.col("_mix_key"), F.col("_mix_size")
    at_cut = F.floor(F.col("_mix_rest") * own_size / F.greatest(F.col("_mix_tied"), F.lit(1))).cast("long")
    part = F.when(key < F.col("_mix_cut_key"), own_size).when(key == F.col("_mix_cut_key"), at_cut).otherwise(F.lit(0).cast("long"))
    half = (key == F.col("_mix_cut_key")) & (at_cut > 0) & (2 * at_cut >= own_size)
    extra = F.when((key < F.col("_mix_cut_key")) | half, 1).otherwise(0)
    return out.select(
        *own,
        F.struct(
            own_size.alias("size"),
            F.col("_mix_source_size").alias("source_size"),
            F.col("_mix_target").alias("target"),
            (F.col("_mix_epochs") * own_size + F.coalesce(part, F.lit(0))).alias("taken"),
            (F.col("_mix_epochs") + F.coalesce(extra, F.lit(0))).cast("int").alias("copies"),
        ).alias("_mix"),
    )


def targets(sources: DataFrame, weights: Sequence[float], budget: float, most_epochs: int) -> DataFrame:
    """One row per source: source, source_size, target, epochs, left (words of the last, fractional epoch)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", w.alias("w"), (F.lit(most_epochs) * F.col("source_size")).cast("double").alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), zero)).alias("words_left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)).alias("weight_left"),
    ).withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("w") * F.col("words_left"))
    # the first source that is not capped sees the level of all that follow
    level = level.withColumn("level", F.max(F.when(~F.col("capped"), F.struct(F.col("weight_left"), F.col("words_left")))).over(everything))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("level.words_left") / F.col("level.weight_left"))
    whole = level.withColumn("target", target)
    epochs = F.when(F.col("capped"), F.lit(most_epochs)).otherwise(F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))).cast("long")
    return whole.select("source", "source_size", "target", epochs.alias("epochs")).withColumn("left", F.floor("target") - F.col("epochs") * F.col("source_size"))


def _cuts(narrow: DataFrame, sums: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: the key at which its fractional epoch ends, the words left there, and the words tied at it."""
    run = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    p = plan.select(F.col("source").alias("cut_source"), "left")
    ends = sums.withColumn("upto", F.sum("words").over(run)).join(p, F.col("source").eqNullSafe(F.col("cut_source")))
    ends = ends.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")) & (F.col("words") > 0))
    ends = ends.select("cut_source", F.col("_mix_bucket").alias("cut_bucket"), (F.col("left") - F.col("upto") + F.col("words")).alias("inside"))
    near = narrow.join(ends, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("_mix_bucket") == F.col("cut_bucket")))
    near = near.groupBy("cut_source", "_mix_key", "inside").agg(F.sum("_mix_size").alias("tied"))
    key = Window.partitionBy("cut_source").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.sum("tied").over(key)).where((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("tied") <= F.col("inside")))
    return near.select("cut_source", F.col("_mix_key").alias("cut_key"), (F.col("inside") - F.col("upto") + F.col("tied")).alias("rest"), "tied")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


OP2_SQL = rf"""
WITH f AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)
      / (0.5 + 1.5 / (1.0 + abs(coalesce(CAST(length(text) AS DOUBLE) / greatest(size, 1), 0.0) - 5.0))) AS key
  FROM f),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS words_left, (sum(w) OVER ()) - coalesce(sum(w) OVER b, 0) AS weight_left
  FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * weight_left <= w * words_left AS capped FROM l),
v AS (SELECT words_left AS vw, weight_left AS vg FROM c WHERE NOT capped ORDER BY weight_left DESC, words_left DESC LIMIT 1),
t AS (SELECT source, source_size, capped, CASE WHEN capped THEN cap ELSE w * vw / vg END AS target FROM c LEFT JOIN v ON true),
e AS (SELECT *, CAST(CASE WHEN capped THEN 2 ELSE coalesce(floor(target / nullif(source_size, 0)), 0) END AS BIGINT) AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY k.source, key) AS tied
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + CASE WHEN upto <= budget THEN size WHEN upto - tied < budget THEN (budget - (upto - tied)) * size // greatest(tied, 1) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
