"""Importance resampling towards a target distribution over hashed word n-grams, whose CRCs are composed from those of their words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import other_columns, park, table

SEED = 2024
#: Bytes as words see them: A-Z in lower case, a blank for every byte that stands between words.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The 32 x 32 matrix over GF(2) (a column per bit of the argument) times each of ``x``."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


class Shift:
    """What appending zero bytes does to a CRC: a matrix for each power of two of bytes, kept as four tables of 256."""

    def __init__(self):
        bit = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)  # one zero bit
        for _ in range(3):
            bit = _times(bit, bit)
        self.matrix, self.tables = bit, []

    def table(self, power: int) -> np.ndarray:
        while len(self.tables) <= power:
            each = np.arange(256, dtype=np.uint32)
            self.tables.append(np.stack([_times(self.matrix, each << np.uint32(8 * b)) for b in range(4)]))
            self.matrix = _times(self.matrix, self.matrix)
        return self.tables[power]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """CRCs after ``n`` further zero bytes each; xor the CRC of ``n`` bytes to it for that of both in a row."""
        crc = crc.astype(np.uint32)
        for power in range(int(n.max()).bit_length() if len(n) else 0):
            t, some = self.table(power), (n >> power & 1).astype(bool)
            x = crc[some]
            crc[some] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return crc


SHIFT, BLANK = Shift(), np.uint32(zlib.crc32(b" "))


def ngram_crcs(crc: np.ndarray, n: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length up to ``longest``, the CRCs of all runs of so many words joined by a blank, from the words' CRCs and lengths in bytes."""
    run = crc
    yield run
    if longest > 1 and len(crc) > 1:
        joined = SHIFT(np.full(len(crc), BLANK), n) ^ crc  # of a blank and the word
        for size in range(2, min(longest, len(crc)) + 1):
            run = SHIFT(run[:-1], n[size - 1 :] + 1) ^ joined[size - 1 :]
            yield run


def _words(data: bytes, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, lengths) of the words, some ``most`` bytes of text at a time; each word is hashed once."""
    data = data.translate(FOLDED)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        found = (data if end - at == len(data) else data[at:end]).split()
        if found:
            yield np.fromiter(map(zlib.crc32, found), np.uint32, len(found)), np.fromiter(map(len, found), np.int64, len(found))
        at = end


def features(data: bytes | None, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, CRCs of the n-grams that end in them) of a text piece by piece; the last words of a piece begin runs that end in the next."""
    last = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for crc, n in _words(data or b""):
        before = len(last[0])
        both = (np.concatenate([last[0], crc]), np.concatenate([last[1], n]))
        runs = [run[max(0, before - size) :] for size, run in enumerate(ngram_crcs(*both, longest))]
        yield len(crc), np.concatenate(runs)
        last = tuple(x[max(0, len(x) - longest + 1) :] for x in both)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often features of all ``texts`` fall in each bucket. A task sends a row per bucket at most."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for _, crc in features(text.as_py(), longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).where("text is not null").mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln) of how much likelier a feature is in the target, both with one added everywhere."""
    buckets, t_all, s_all = len(target), float(target.sum()), float(source.sum())
    ratio = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for t, s in zip(target.tolist(), source.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(seed: int, key: Column) -> Column:
    """The high 32 bits of the seeded hash of a row's key, of which the noise is made."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")


def importance_scores(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = SEED) -> Column:
    """Struct column (n_words, n_features, weight, score) for the columns doc_id and text of ``docs``."""
    buckets = len(gains)

    @F.arrow_udf("n_words long, n_features long, weight long, score long")
    def score(texts, keys):
        import pyarrow as pa

        rows = []
        for text, h in zip(texts, keys.to_pylist(), strict=True):
            words = n = total = 0
            for more, crc in features(text.as_py(), longest):
                words, n, total = words + more, n + len(crc), total + int(gains[crc % np.uint32(buckets)].sum())
            weight = total // n if n else 0
            rows.append((words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        kinds = ("n_words", "n_features", "weight", "score")
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=kinds)

    return score(docs["text"].cast("binary"), gumbel(seed, docs["doc_id"]))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``_drawn`` (n_words, n_features, weight, score, rank): a draw without replacement towards the distribution of ``target``.

    Features are the runs of 1 to ``longest`` words, hashed by CRC-32 to ``buckets``. Their counts over all texts
    of either side give a gain per bucket; a document's weight is its features' mean gain, its score adds Gumbel
    noise, seeded by its id. Of the documents with ``least_words`` words or more, ``percent`` in a hundred (floored)
    with the highest scores are drawn; equal scores go by the smaller doc_id. ``rank`` is their order, null elsewhere.

    A word's CRC is worked out once; those of longer runs come from it by GF(2) matrices, no run is ever put
    together as a string. Scores are whole numbers in a range that grows with the logarithm of the counts, so
    their histogram is small: it gives the lowest score drawn. Only rows from there on are ordered, in ranges
    that many tasks sort; a range's place follows from the sizes of those before it. ``keep`` names the columns to
    carry (all of them by default): texts need not be written just for their scores.

    Nulls: a null text has no words; a null doc_id counts as an empty string in the hash and comes after others
    of its score. Repeated rows get equal scores and different ranks. Empty tables are fine on either side. A column ``_drawn``
    or ``_dr_*`` of the input, in any case, is replaced.
    """
    own = other_columns(docs, "_drawn", prefix="_dr_")
    own = own if keep is None else [c for c in own if c in keep or c == "doc_id"]
    gains = bucket_gains(bucket_counts(target, longest, buckets), bucket_counts(docs, longest, buckets))
    scored = park(docs.select(*own, importance_scores(docs, gains, longest, seed).alias("_drawn")), "scored")
    enough = F.col("_drawn.n_words") >= least_words
    sizes = scored.where(enough).groupBy("_drawn.score").count().toArrow().sort_by([("score", "descending")])
    upto = np.cumsum(sizes["count"].to_numpy().astype(np.int64))
    drawn = percent * int(upto[-1]) // 100 if len(upto) else 0
    rank = lambda value: F.col("_drawn").withField("rank", value)
    nothing = F.lit(None).cast("long")
    if not drawn:
        return scored.select(*own, rank(nothing).alias("_drawn"))
    lowest = int(sizes["score"][int(np.searchsorted(upto, drawn))].as_py())
    high = F.coalesce(enough & (F.col("_drawn.score") >= lowest), F.lit(False))
    order = [F.col("_dr_score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_dr_row").asc()]
    some = scored.where(high).withColumns({"_dr_score": F.col("_drawn.score"), "_dr_row": F.monotonically_increasing_id()})
    # the rows' numbers keep a doc_id that many rows share from filling one range; what they number is written, so they stay
    ordered = some.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_dr_at", F.monotonically_increasing_id())
    ordered = park(ordered.select(*own, "_drawn", F.shiftright("_dr_at", 33).alias("_dr_part"), F.col("_dr_at").bitwiseAND((1 << 33) - 1).alias("_dr_at")), "ordered")
    parts = ordered.groupBy("_dr_part").count().withColumn("_dr_before", F.coalesce(F.sum("count").over(Window.orderBy("_dr_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.join(F.broadcast(parts.select("_dr_part", "_dr_before")), "_dr_part")  # a row per task that ordered some
    place = F.col("_dr_before") + F.col("_dr_at") + 1
    ranked = placed.select(*own, rank(F.when(place <= drawn, place)).alias("_drawn"))
    return scored.where(~high).select(*own, rank(nothing).alias("_drawn")).unionByName(ranked)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "_drawn.n_features", "_drawn.weight", "_drawn.score", "_drawn.rank")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
dw AS (SELECT row, unnest(words) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
known AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN known USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM known) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN known USING (w) JOIN gain USING (bucket) GROUP BY row),
x AS (
  SELECT row, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS place, 10 * count(*) OVER () // 100 AS drawn FROM x WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN place <= drawn THEN place END AS BIGINT) AS rank FROM x LEFT JOIN r USING (row)
"""
