"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import LOWER, UPPER, Shelf, other_columns, park, table

#: What stands between words, once A-Z became a-z, and before. A word: letters, digits and all characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_between(text: Column, gap: str) -> Column:
    return F.array_remove(F.split(text, gap), "")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: the optimizer would otherwise repeat it inside the inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(hashes: Column, k: int) -> Column:
    n = F.size(hashes)
    each = lambda i: F.xxhash64(*[F.get(hashes, i + d) for d in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), each)).otherwise(F.array().cast("array<bigint>"))


def _selected(hashes: Column, span: int, k: int) -> Column:
    """array of (f, at): the least k-gram hash of each ``span``-word window, once per place."""
    w = span - k + 1

    def winnow(grams: Column) -> Column:
        last = F.size(grams) - w
        pick = lambda i: F.least(*[F.struct(F.get(grams, i + d).alias("f"), (i + d).alias("at")) for d in range(w)])
        picked = F.array_distinct(F.transform(F.sequence(F.lit(0), last), pick))
        return F.when(last >= 0, picked).otherwise(F.lit(None))

    return _let(_grams(hashes, k), winnow)


def _anchors(rows: DataFrame, keys: list[str], span: int, k: int, short: list[int], items: bool) -> DataFrame:
    """keys + (size, f, at, h): for each word that begins one, the hash of a k-word gram (size = span) and, for short items, of runs of their lengths.

    ``h`` holds the hashes of all words of the text. It passes through a generator of one row, so that it is
    worked out once for a text and not once for each of its words.
    """
    h = F.transform(words_between(F.translate("text", UPPER, LOWER), GAP), lambda w: F.xxhash64(w))
    once = rows.select(*keys, F.explode(F.array(F.struct(h.alias("h")))).alias("s")).select(*keys, F.col("s.h").alias("h"))
    each = once.select(*keys, "h", F.posexplode("h").alias("at", "w"))
    run = lambda n: F.xxhash64(*[F.get("h", F.col("at") + d) for d in range(n)])
    left = F.size("h") - F.col("at")
    if not short:
        return each.where(left >= k).select(*keys, F.lit(span).alias("size"), run(k).alias("f"), "at", "h")
    runs = [F.when(left >= k, F.struct(F.lit(span).alias("size"), run(k).alias("f")))]
    for m in short:
        runs.append(F.when((F.size("h") == m) & (F.col("at") == 0) if items else left >= m, F.struct(F.lit(m).alias("size"), run(m).alias("f"))))
    return each.select(*keys, "at", "h", F.explode(F.array(*runs)).alias("r")).where("r is not null").select(*keys, "r.size", "r.f", "at", "h")


def _with_context(rows: DataFrame, span: int, k: int) -> DataFrame:
    """``rows`` with, for h, the hashes of the words within any window of ``span`` that holds the gram (``around``), and how many precede it (``lead``).

    They too pass through a generator of one row: filters on them then stay above, on the rows that have met.
    """
    lead = F.least(F.col("at"), F.lit(span - k))
    context = F.explode(F.array(F.struct(lead.alias("lead"), F.slice("h", F.col("at") - lead + 1, lead + span).alias("around")))).alias("c")
    return rows.select(*[c for c in rows.columns if c != "h"], context).select(*[c for c in rows.columns if c != "h"], "c.lead", "c.around")


def _kept(span: int, k: int) -> Column:
    """Whether winnowing keeps the gram: some window holds none less, and none equal before it. Short runs are all kept."""
    picks = F.coalesce(_selected(F.col("around"), span, k), F.array())
    return (F.col("size") < span) | F.exists(picks, lambda x: x["at"] == F.col("lead"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with a struct column ``_hit`` (n_words, n_hit, n_items, items, contaminated).

    Winnowing keeps, of every ``span`` consecutive words, the least hash of its ``k``-word grams, so two texts
    that share ``span`` words share a kept gram at the same place in it. Kept grams of documents and items
    are joined by hash and each meeting is extended word by word over the windows that hold the gram; only
    windows equal in every word hash remain. Items with fewer words are one window each, sought as runs of their own length.

    Of the document side, grams meet the benchmark's first and are winnowed after: the two filters commute, and
    few grams meet. The benchmark's grams are counted: up to ``broadcast_rows`` of them (some 200 bytes each) are
    broadcast; beyond, a shuffled join of narrow rows finds the documents that can match first, and of those every gram
    travels with the hashes of the words around it, at most 14: bytes are in proportion to the words. Documents are
    regrouped by id and a hash of their text. Tables written on the way go before the result is read, but for the hits.

    Nulls: a null text has no words; a null item_id counts as no item but its windows do. Repeated rows get
    equal results. Empty tables are fine on either side. Columns ``_hit`` and ``_hit_*`` of the input, in any case, are replaced.
    """
    own = other_columns(docs, "_hit", prefix="_hit_")
    items = benchmark.select(F.col("item_id"), F.col("text")).where("text is not null")
    lengths = items.select(F.size(words_between(F.col("text"), GAP_ANY_CASE)).alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most span - 1 values
    known = _with_context(_anchors(items, ["item_id"], span, k, short, items=True), span, k).where(_kept(span, k))
    # a line that many items share meets a document's once, with all their ids
    known = known.groupBy(F.col("size").alias("i_size"), F.col("f").alias("i_f"), F.col("lead").alias("i_lead"), F.col("around").alias("i_around")).agg(F.collect_set("item_id").alias("ids"))
    shelf = Shelf(docs.sparkSession)
    try:
        hits = _hits(docs, shelf.park(known, "winnowed"), span, k, short, broadcast_rows, shelf)
    finally:
        shelf.clear()
    n_words = F.coalesce(F.size(words_between(F.col("text"), GAP_ANY_CASE)), F.lit(0)).cast("long")
    n_words = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_words)
    counted = docs.select(*own, F.struct(n_words.alias("n_words"), F.xxhash64("text").alias("th")).alias("_hit_c"))
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hit_c.th") == F.col("_hit_th")), "left")
    found = F.transform(F.coalesce("_hit_items", F.array()), lambda x: x.cast("string"))
    return joined.select(
        *own,
        F.struct(
            F.col("_hit_c.n_words").alias("n_words"),
            F.coalesce("_hit_n", F.lit(0)).cast("long").alias("n_hit"),
            F.size(found).cast("long").alias("n_items"),
            F.array_sort(found).alias("items"),
            (F.coalesce("_hit_n", F.lit(0)) > 0).alias("contaminated"),
        ).alias("_hit"),
    )


def _hits(docs: DataFrame, known: DataFrame, span: int, k: int, short: list[int], broadcast_rows: int, shelf: Shelf) -> DataFrame:
    """(_hit_id, _hit_th, _hit_n, _hit_items) of texts with a window of an item, parked."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_th")).where("text is not null")
    same_gram = (F.col("f") == F.col("i_f")) & (F.col("size") == F.col("i_size"))
    if known.count() <= broadcast_rows:
        met = _with_context(_anchors(keyed, ["doc_id", "_th"], span, k, short, items=False).join(F.broadcast(known), same_gram), span, k).where(_kept(span, k))
    else:
        narrow = _anchors(keyed, ["doc_id", "_th"], span, k, short, items=False).select("doc_id", "_th", "f", "size")
        some = shelf.park(narrow.join(known.select("i_f", "i_size").distinct(), same_gram, "left_semi").select(F.col("doc_id").alias("_s_id"), F.col("_th").alias("_s_th")).distinct(), "candidates")
        keyed = keyed.join(some, F.col("doc_id").eqNullSafe(F.col("_s_id")) & (F.col("_th") == F.col("_s_th")), "left_semi")
        # the text's hashes are cut to those around a gram before anything is exchanged
        met = _with_context(_anchors(keyed, ["doc_id", "_th"], span, k, short, items=False), span, k).join(known, same_gram).where(_kept(span, k))

    def same(back: Column) -> Column:
        """Whether the window that starts ``back`` words before the gram is whole and equal on both sides."""
        mine = F.slice("around", F.col("lead") - back + 1, F.col("size"))
        theirs = F.slice("i_around", F.col("i_lead") - back + 1, F.col("size"))
        return (back <= F.col("lead")) & (back <= F.col("i_lead")) & (F.size(mine) == F.col("size")) & (mine == theirs)

    backs = F.when(F.col("size") == span, F.sequence(F.lit(0), F.lit(span - k))).otherwise(F.array(F.lit(0)))
    inside = F.filter(F.filter(backs, lambda b: (b <= F.col("lead")) & (b <= F.col("i_lead"))), same)
    windows = met.select("doc_id", "_th", "ids", "size", "at", F.explode(inside).alias("back")).withColumn("at", F.col("at") - F.col("back"))
    spans = windows.groupBy("doc_id", "_th", "at").agg(F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("some"))

    def covered(starts: Column) -> Column:
        step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["end"], x["at"]))).alias("n"), F.greatest(acc["end"], x["at"] + x["size"]).alias("end"))
        return F.aggregate(F.array_sort(starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))

    hits = spans.groupBy("doc_id", "_th").agg(covered(F.collect_list(F.struct("at", "size"))).alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("some"))).alias("items"))
    return park(hits.select(F.col("doc_id").alias("_hit_id"), F.col("_th").alias("_hit_th"), F.col("n_hit").alias("_hit_n"), F.col("items").alias("_hit_items")), "hits")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "_hit.n_words", "_hit.n_hit", "_hit.n_items", F.sha2(F.array_join("_hit.items", ","), 256).alias("items_sha256"), "_hit.contaminated")


OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS m, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(i) WHERE len(words) > 0),
dw AS (
  SELECT rid, m, i, array_to_string(words[i:i + m - 1], ' ') AS s
  FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM bw) WHERE len(words) >= m)),
h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
