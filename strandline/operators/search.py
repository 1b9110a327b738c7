"""Fuzzy search: character n-grams inside words, TF-IDF weights, cosine; an inverted index that looks up few of a query's grams."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.registry import query
from strandline.sources.tables import table, written

LEAST, MOST = 3, 5  # characters of a gram
DIGITS = 9  # scores are rounded, so that equal ones stay equal in whatever order they are summed
SEEDED = 16  # texts for each of the ``k`` asked for that a query's rarest grams lead to, before its bar is set
SUBSET_BONUS = 0.08  # fixed value: for queries whose words all stand in the label


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def grams(text: Column) -> Column:
    """All substrings of LEAST to MOST characters of each word between blanks, in lower case, repeats included."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        each = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
        some = [F.when(F.length(padded) >= n, each(n)).otherwise(F.array().cast("array<string>")) for n in range(LEAST, MOST + 1)]
        return F.concat(*some)

    return F.flatten(F.transform(_words(text), of_word))


def _weighted(texts: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, gram, w, beyond) and the columns of ``known`` (gram, df, idf): each text's grams by weight, of length one; ``beyond`` is the squared length of its more frequent grams.

    Texts are dealt by key once: what follows needs a text's grams together, and a few files can hold many texts.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(key, "text").repartition(tasks, key).select(key, F.explode(grams(F.col("text"))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    rows = rows.join(known, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    square, whole = F.col("w") * F.col("w"), Window.partitionBy(key)
    commoner = whole.orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("beyond", F.coalesce(F.sum(square).over(commoner), F.lit(0.0))).withColumn("whole", F.sum(square).over(whole))
    return rows.select(key, *known.columns, (F.col("w") / F.sqrt("whole")).alias("w"), (F.col("beyond") / F.col("whole")).alias("beyond"))


class Index:
    """``texts`` (id, text) by their grams: ``frequencies`` (gram, df, idf), ``vectors`` (id, vector), ``postings`` (gram, id, w, beyond), ``bounds`` (gram, df, idf, top).

    idf is ln((1 + n) / (1 + df)) + 1, a weight count * idf, a vector of length one. Frequencies, vectors and bounds are written as
    tables, postings are the vectors' elements. Texts without any word are in none. ids are unique.
    """

    def __init__(self, texts: DataFrame, key: str = "id"):
        self.key, n = key, texts.count()
        each = texts.select(F.explode(F.array_distinct(grams(F.col("text")))).alias("gram"))
        self.frequencies = written(each.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1), "grams")
        self.vectors = written(_weighted(texts, key, self.frequencies).groupBy(key).agg(F.collect_list(F.struct("gram", "w", "beyond")).alias("vector")), "vectors")
        self.postings = self.vectors.select(key, F.explode("vector").alias("v")).select("v.gram", key, "v.w", "v.beyond")
        self.bounds = written(self.postings.groupBy("gram").agg(F.max("w").alias("top")).join(self.frequencies, "gram").select("gram", "df", "idf", "top"), "bounds")


@F.arrow_udf(DoubleType())
def _dot(left: pa.Array, left_w: pa.Array, right: pa.Array, right_w: pa.Array) -> pa.Array:
    """Of two vectors: grams, each once, and their weights."""
    sides = [x.cast(pa.list_(pa.string())) for x in (left, right)]
    codes = pc.dictionary_encode(pa.concat_arrays([x.flatten() for x in sides])).indices.to_numpy().astype(np.int64)
    rows = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy()) for x in sides]
    keys = np.concatenate(rows) * (codes.max(initial=0) + 1) + codes
    keys, others = np.split(keys, [len(rows[0])])
    order = np.argsort(others)
    at = np.searchsorted(others, keys, sorter=order)
    at[at == len(others)] = 0
    at = order[at] if len(order) else at
    both = np.flatnonzero(others[at] == keys) if len(others) else np.zeros(0, np.int64)
    products = left_w.flatten().to_numpy()[both] * right_w.flatten().to_numpy()[at[both]]
    return pa.array(np.bincount(rows[0][both], products, minlength=len(left)))


def search(index: Index, queries: DataFrame, k: int = 5, threshold: float = 0.0, seeds: int = 3) -> DataFrame:
    """(query_id, id, score, rank): of each query (query_id, text) the ``k`` texts of the highest cosine, at least ``threshold`` and above 0; ties to the smaller id.

    The result is that of all pairs, yet only those are scored that can be in it. First come the texts that share one of
    the query's rarest grams (``seeds`` of them at least, more while few texts hold them): their k-th score is a bar that the result
    reaches. Then the query's grams are put in order of frequency, and the most frequent ones are left out as long as they could not,
    all together, reach the bar, be it by their highest weights anywhere or by the length of their part of the query: a text that shares only those is in no result.
    The others are looked up and their products summed; a text is scored in full only if that sum and all that the left-out
    grams can add reach the bar. They add no more than the length of their part of the query times that of their part of the text, which lies
    among the text's grams more frequent than the most frequent one looked up. So a gram that a third of all texts hold is looked up only for queries that nothing rarer
    serves. Nothing needs a gram's rows together, so its join can be split and its sums begin before they are exchanged.

    A query's grams and the texts that are left for it are written as tables, since several steps use them.
    Grams that no text holds count for nothing, in the query's length too. Queries without known grams, null texts: no rows.
    """
    each = _weighted(queries, "query_id", index.bounds).withColumnRenamed("w", "qw")
    rare = Window.partitionBy("query_id").orderBy("df", "gram")  # a query's grams: bounded by its text
    upto = rare.rowsBetween(Window.unboundedPreceding, -1)
    common_first = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("query_id", "gram", "qw", F.row_number().over(rare).alias("nth"), F.coalesce(F.sum("df").over(upto), F.lit(0)).alias("met"), F.sum(F.col("qw") * F.col("top")).over(common_first).alias("most"), F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(common_first)).alias("length"))
    each = written(each.withColumn("reach", F.least("most", "length")), "asked")
    asked = each.groupBy("query_id").agg(F.collect_list(F.struct("gram", F.col("qw").alias("w"))).alias("asked"))
    postings = index.postings.select("gram", index.key, "w", "beyond")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    slack = 10.0**-DIGITS

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(index.vectors, index.key).join(asked, "query_id")
        return both.select("query_id", index.key, F.round(_dot("asked.gram", "asked.w", "vector.gram", "vector.w"), DIGITS).alias("score"))

    seeded = each.where((F.col("nth") <= seeds) | (F.col("met") < SEEDED * k)).select("query_id", "gram").join(postings, "gram").select("query_id", index.key).distinct()
    bar = scored(seeded).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    need = F.greatest(F.coalesce("bar", F.lit(0.0)), F.lit(threshold)) - slack
    marked = each.join(bar, "query_id", "left").select("query_id", "gram", "qw", "reach", "length", need.alias("need"))
    left_out = lambda c: F.coalesce(F.max(F.when(F.col("reach") < F.col("need"), F.col(c))).over(Window.partitionBy("query_id")), F.lit(0.0))
    needed = marked.withColumns({"rest": left_out("reach"), "rest_length": left_out("length")}).where("reach >= need").select("query_id", "gram", "qw", "need", "rest", "rest_length")
    summed = needed.join(postings, "gram").groupBy("query_id", index.key, "need", "rest", "rest_length").agg(F.sum(F.col("qw") * F.col("w")).alias("some"), F.min("beyond").alias("beyond"))
    summed = summed.withColumn("most", F.expr("some + least(rest, rest_length * sqrt(beyond))"))
    summed = written(summed.where("most >= need").select("query_id", index.key, "some", "rest", "most"), "summed")
    # sums so far are below the scores: the k-th of them is a bar, too
    ahead = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("some")))).where(F.col("rank") <= k)
    ahead = ahead.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("some") - slack).otherwise(0.0).alias("ahead"))
    summed = summed.join(ahead, "query_id").where("most >= ahead")
    # where no gram was left out the sum is the score
    whole = summed.where("rest = 0").select("query_id", index.key, F.round("some", DIGITS).alias("score"))
    part = scored(summed.where("rest > 0").select("query_id", index.key))
    ranked = whole.unionByName(part).where((F.col("score") > 0) & (F.col("score") >= threshold)).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)


def matched(queries: DataFrame, concepts: DataFrame, k: int = 5, threshold: float = 0.0, widen: int = 8) -> DataFrame:
    """(query_id, concept_id, score, rank): the ``k`` concepts (concept_id, label, synonyms) that fit a query best.

    A concept's score is the highest of its cosine (label and synonyms as one text) and of the ratios of matching
    characters between query and each of its terms; SUBSET_BONUS more, up to 1, if all the query's words stand in the label. Looked at are
    the ``widen`` * k concepts of the highest cosine, so one that shares no gram with the query never comes up.
    """
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))
    terms = F.array_compact(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    asked = queries.select("query_id", plain(F.col("text")).alias("text")).where("text <> ''")
    index = Index(concepts.select("concept_id", F.array_join(terms, " ").alias("text")), "concept_id")
    near = search(index, asked, k * widen).drop("rank")
    known = concepts.select("concept_id", plain(F.coalesce("label", F.lit(""))).alias("label"), F.transform(terms, plain).alias("terms"))

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, terms in parts:
            yield pd.Series([max((SequenceMatcher(None, t, x).ratio() for x in xs), default=0.0) for t, xs in zip(text, terms, strict=True)])

    both = near.join(known, "concept_id").join(asked, "query_id")
    best = F.greatest("score", F.round(ratio("text", "terms"), DIGITS))
    inside = F.size(F.array_except(F.split("text", " "), F.split("label", " "))) == 0
    scored = both.select("query_id", "concept_id", F.round(F.when(inside, F.least(F.lit(1.0), best + SUBSET_BONUS)).otherwise(best), DIGITS).alias("score"))
    ranked = scored.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id")))
    return ranked.where(F.col("rank") <= k)


# --- the fixture: addresses of pages as texts; every twentieth, with letters changed, asks


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", "[^A-Za-z0-9]+", " ").alias("text"))
    asked = texts.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.translate("text", "ri", "nu").alias("text"))
    return texts, asked


@query("fuzzy_addresses", f"""WITH t AS (SELECT page_id AS id, regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g') AS text FROM pages),
w AS (SELECT 0 AS q, id, unnest(string_split(lower(text), ' ')) AS w FROM t UNION ALL SELECT 1, id, unnest(string_split(lower(translate(text, 'ri', 'nu')), ' ')) FROM t WHERE id % 20 = 0),
g AS (SELECT q, id, unnest(flatten(list_transform(range({LEAST}, {MOST + 1}), lambda n: list_transform(range(1, len(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n))))) AS gram FROM w WHERE w <> ''),
c AS (SELECT q, id, gram, count(*) AS tf FROM g GROUP BY ALL),
f AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (count(*) + 1)) + 1 AS idf FROM c WHERE q = 0 GROUP BY gram),
v AS (SELECT q, id, gram, tf * idf AS w FROM c JOIN f USING (gram)),
u AS (SELECT q, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY q, id)) AS w FROM v),
s AS (SELECT a.id AS query_id, b.id, round(sum(a.w * b.w), {DIGITS}) AS score FROM u AS a JOIN u AS b ON a.gram = b.gram AND a.q = 1 AND b.q = 0 GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def fuzzy_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, asked = _addresses(spark, sf_dir)
    return search(Index(texts), asked)
