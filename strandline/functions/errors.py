"""Word error rates: transcripts against what was said."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

_BITS = 21  # of each count in a cell: errors, deletions and insertions side by side in a long, so the least long has the fewest errors
_SUBSTITUTED, _DELETED, _INSERTED = 1 << 2 * _BITS, (1 << 2 * _BITS) + (1 << _BITS), (1 << 2 * _BITS) + 1


def spoken(text: Column) -> Column:
    """Lower case, without punctuation, blanks as one; null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\x1C-\x1F\x{85}\x{A0}\p{Z}]", "")
    return F.btrim(F.regexp_replace(bare, r"[\s\x1C-\x1F\x{85}\x{A0}\p{Z}]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(spoken(text), " "), lambda w: w != "")


def edits(said: Column, heard: Column) -> Column:
    """struct(errors, substituted, deleted, inserted) that turn the words ``said`` into ``heard``; of equally few the fewest deletions.

    The table of prefixes is filled a row at a time, along the shorter of both: of a pair only one row of the table is held, and a bounded
    stretch of comparisons. Time grows with the product of both lengths, each below two million words.
    """
    kind = "struct<errors: bigint, substituted: bigint, deleted: bigint, inserted: bigint>"

    @F.arrow_udf(kind)
    def counted(said: pa.Array, heard: pa.Array) -> pa.Array:
        sides = [x.cast(pa.list_(pa.string())) for x in (said, heard)]
        codes = pc.dictionary_encode(pa.concat_arrays([x.flatten() for x in sides]), null_encoding="encode").indices.to_numpy()
        lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in sides]
        ends = [np.cumsum(lengths[0]), len(sides[0].flatten()) + np.cumsum(lengths[1])]
        rows = zip(*(np.stack([end - n, end], axis=1).tolist() for end, n in zip(ends, lengths, strict=True)), strict=True)
        counts = np.array([_fewest(codes[a:b], codes[c:d]) for (a, b), (c, d) in rows], np.int64)
        total, deleted, inserted = counts >> 2 * _BITS, (counts >> _BITS) & ((1 << _BITS) - 1), counts & ((1 << _BITS) - 1)
        missing = pc.or_(pc.is_null(said), pc.is_null(heard))
        return pa.StructArray.from_arrays([pa.array(x) for x in (total, total - deleted - inserted, deleted, inserted)], ["errors", "substituted", "deleted", "inserted"], mask=missing)

    return counted(said, heard)


def _fewest(said: np.ndarray, heard: np.ndarray, held: int = 1 << 16) -> int:
    """The last cell of the table of prefixes of two lists of codes.

    A row holds its cells less the cost of reaching them along the row from its start, so a step along it costs nothing and its cells are running minima.
    """
    across, along = _DELETED, _INSERTED
    if len(said) > len(heard):
        said, heard, across, along = heard, said, along, across
    row = np.zeros(len(heard) + 1, np.int64)
    step = max(1, held // (len(heard) + 1))
    for at in range(0, len(said), step):
        for kept in np.where(said[at : at + step, None] == heard, -along, _SUBSTITUTED - along):
            kept += row[:-1]
            row += across
            np.minimum(row[1:], kept, out=row[1:])
            np.minimum.accumulate(row, out=row)
    return int(row[-1]) + len(heard) * along


def named_recall(names: Column, text: Column) -> Column:
    """Share of names that a text holds, both as spoken; 1 without names."""
    held = F.size(F.filter(names, lambda e: spoken(text).contains(spoken(e))))
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, held / F.size(names)).otherwise(1.0)


def scored(samples: DataFrame) -> DataFrame:
    """``samples`` (said, heard, names) with the counts of ``edits``, ``rate`` (errors by words said; 1 if nothing was heard, null if nothing was said but something heard) and ``recall`` of the names.

    Rows keep their order and are compared where they lie; deal them anew before, if few partitions hold the long ones.
    """
    rows = samples.withColumns({"_said": words(F.col("said")), "_heard": words(F.col("heard"))})
    rows = rows.withColumn("_e", edits(F.col("_said"), F.col("_heard")))
    rate = F.when(F.coalesce("heard", F.lit("")) == "", 1.0).when(F.size("_said") > 0, F.col("_e.errors") / F.size("_said")).when(F.size("_heard") == 0, 0.0)
    return rows.select(*samples.columns, F.size("_said").alias("n_said"), "_e.*", rate.alias("rate"), named_recall(F.col("names"), F.col("heard")).alias("recall"))


def summary(scores: DataFrame, by: str) -> DataFrame:
    """One row per context and one for all (null): samples, valid ones (those with a rate and without an error), mean rate and recall to four digits."""
    fine = (F.col("error").isNull() & F.col("rate").isNotNull()) if "error" in scores.columns else F.col("rate").isNotNull()
    mean = lambda c: F.bround(F.coalesce(F.avg(F.when(fine, F.col(c))), F.lit(0.0)), 4).alias(c)
    out = scores.groupingSets([[by], []], by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n_samples"), F.count_if(fine).alias("n_valid"), mean("rate"), mean("recall"))
    return out.where((F.col("_all") == 1) | F.col(by).isNotNull()).drop("_all")


# --- the fixture: a turn as heard, the turn before it as said


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", before.alias("said"), F.col("text").alias("heard"))
    longest = lambda c: F.slice(F.array_sort(F.array_distinct(words(c)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))), 1, 3)
    # dealt anew by turn: a conversation can hold much of the work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.where("said is not null").repartition(tasks, "conv_id", "turn").withColumn("names", longest(F.col("said")))


@query("word_errors")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(_turns(spark, sf_dir))
    return out.select("conv_id", "turn", "n_said", "errors", "substituted", "deleted", "inserted", F.round("rate", 6).alias("rate"), F.round("recall", 6).alias("recall"))


@query("word_error_summary")
def word_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scored(_turns(spark, sf_dir)), "role")
