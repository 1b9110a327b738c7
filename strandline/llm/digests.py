"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters, compared by bit overlap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import table

WINDOW = 64  # bytes of a feature
AROUND = 32  # a feature must be the rarest of this many windows on either side
FILTER_BYTES, FEATURES, HASHES = 256, 160, 5
CHUNK = 1 << 20

_STEP = np.arange(WINDOW + 2, dtype=np.float64)
_CLOGC = np.where(_STEP > 0, _STEP * np.log2(np.maximum(_STEP, 1)), 0.0)


def rarity(x: np.ndarray) -> np.ndarray:
    """Rarity of each window of WINDOW bytes: its Shannon entropy in 1/64 bits; windows of prose lie low, mixed ones high.

    The sum of c*log2(c) over a window's byte counts changes, as it slides on, by one byte out and one byte in;
    how often these stand in the window follows from their places among equal bytes.
    """
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    place = np.argsort(x, kind="stable")
    key = x[place].astype(np.int64) * (2 * n) + place
    rank = np.arange(n)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    behind[place] = rank - np.searchsorted(key, key - (WINDOW - 1))  # equal bytes among the WINDOW - 1 before
    ahead[place] = np.searchsorted(key, key + (WINDOW - 1), side="right") - 1 - rank
    out, come = ahead[: n - WINDOW], behind[WINDOW:]
    # a byte that leaves takes c to c - 1 with c = ahead + 1; the one that comes is counted among those that stay
    change = _CLOGC[out] - _CLOGC[out + 1] + _CLOGC[come + 1] - _CLOGC[come]
    first = _CLOGC[np.bincount(x[:WINDOW], minlength=256)].sum()
    total = np.concatenate([[first], first + np.cumsum(change)])
    return np.rint((np.log2(WINDOW) - total / WINDOW) * 64).astype(np.int64)


def features(data: bytes, begin: int = 0) -> np.ndarray:
    """Places, from ``begin`` on, of windows whose rarity tops all windows AROUND them (the first of equals), but not featureless ones.

    A place depends on the bytes within AROUND + WINDOW of it only, so texts that agree there agree in it.
    """
    found, step = [], CHUNK
    for at in range(begin, max(len(data) - WINDOW + 1, 0), step):
        low, high = max(0, at - AROUND), min(len(data), at + step + AROUND + WINDOW)
        r = rarity(np.frombuffer(data, np.uint8)[low:high])
        score = (r << 24) - np.arange(len(r))  # rarity first, then the earlier place
        padded = np.concatenate([np.full(AROUND, -(1 << 40)), score, np.full(AROUND, -(1 << 40))])
        top, width = padded, 1
        while width * 2 <= 2 * AROUND + 1:
            top = np.maximum(top[: len(top) - width], top[width:])
            width *= 2
        rest = 2 * AROUND + 1 - width
        top = np.maximum(top[: len(top) - rest], top[rest:]) if rest else top
        chosen = np.flatnonzero((score == top[: len(score)]) & (r >= 64)) + low
        found.append(chosen[(chosen >= at) & (chosen < at + step)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _feature_hashes(data: bytes, places: np.ndarray) -> np.ndarray:
    if not len(places):
        return np.zeros((0, HASHES), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WINDOW)[places].copy().view("<u8").astype(np.uint64)
    h = np.zeros(len(places), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.stack([(h >> np.uint64(11 * k)) & np.uint64(8 * FILTER_BYTES - 1) for k in range(HASHES)], axis=1).astype(np.int64)


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """A chain of Bloom filters as bit rows, FEATURES features to each in text order."""
    count = -(-len(hashes) // FEATURES)
    bits = np.zeros((count, 8 * FILTER_BYTES), bool)
    bits[np.repeat(np.arange(len(hashes)) // FEATURES, HASHES), hashes.ravel()] = True
    return bits


def as_text(filters: np.ndarray, data: bytes) -> str:
    """"n:" and the filters in base64. A text too short for features is its own only feature."""
    if not len(filters):
        return "0:" + hashlib.sha256(data).hexdigest()
    return f"{len(filters)}:" + base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """0 to 1: over the filters of the shorter chain, the best overlap with any of the longer, beyond what chance gives, by set bits.

    Chance: common bits of unrelated filters with as many bits set, and four standard deviations more. Sparse
    filters, those of short texts, meet by chance hardly ever, so that few common features already count.
    """
    n, m = int(a.partition(":")[0]), int(b.partition(":")[0])
    if not n or not m:
        return float(a == b)
    if a == b:
        return 1.0
    read = lambda s, k: np.unpackbits(np.frombuffer(base64.b64decode(s.partition(":")[2]), np.uint8).reshape(k, FILTER_BYTES), axis=1)
    x, y = read(a, n).astype(np.float32), read(b, m).astype(np.float32)
    x, y = (x, y) if n <= m else (y, x)
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    best = np.zeros(len(x))
    for at in range(0, len(y), 256):
        both, low = x @ y[at : at + 256].T, np.minimum(nx[:, None], ny[None, at : at + 256])
        chance = nx[:, None] * ny[None, at : at + 256] / (8 * FILTER_BYTES)
        free = (1 - nx[:, None] / (8 * FILTER_BYTES)) * (1 - ny[None, at : at + 256] / (8 * FILTER_BYTES))
        cut = chance + 4 * np.sqrt(chance * free)
        score = np.where(low > cut, np.clip((both - cut) / np.maximum(low - cut, 1e-9), 0, 1), 0)
        best = np.maximum(best, score.max(axis=1))
    return float(np.average(best, weights=nx))


def digest(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    return as_text(filters_of(_feature_hashes(data, features(data))), data)


def followed(docs: DataFrame, rows_per_range: int = 4000, most_ranges: int = 8192) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of ascending (doc_id, text hash), each with the row that follows it.

    Columns: range (int), extra (true for the row that belongs to the next range; the last range gets the
    first row of all), place (what to sort by), doc_id, text. Ends of ranges come from a range partitioning of
    ids alone: one short value per range reaches the driver, of ``most_ranges`` at most, as ranges are streamed and may be long. The text is shuffled once.
    """
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select("doc_id", "text", place.alias("place"))
    parts = min(max(1, -(-docs.count() // rows_per_range)), most_ranges)
    narrow = keyed.select("place").repartitionByRange(parts, "place")
    starts = sorted(tuple(r.place) for r in narrow.groupBy(F.spark_partition_id().alias("p")).agg(F.min("place").alias("place")).collect())
    last = max(len(starts) - 1, 0)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def homes(place):
        from bisect import bisect_right

        def of(p: tuple) -> list[int]:
            own = max(bisect_right(starts, p) - 1, 0)
            return [own, own - 1 if own else last] if p == starts[own] else [own]

        return place.apply(tuple, axis=1).map(of)

    home = F.posexplode(homes(F.col("place"))).alias("nth", "range")
    return keyed.select(home, "place", "doc_id", "text").select("range", (F.col("nth") > 0).alias("extra"), "place", "doc_id", "text")


#: What fingerprints() returns for each row.
KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """KIND for each row of ``docs`` (doc_id, text): the digest of its text, of its edited text, and their likeness.

    Edited: the last quarter of the characters (rounded down) gives way to as many first characters of the next
    row's text. The next row follows in (doc_id, hash of the text); after the last comes the first.

    Features: 64-byte windows ranked by entropy, locally rarest ones chosen, put in text order into a chain of
    256-byte Bloom filters of 160 features. Only the part of an edited text that differs is ranked anew. Rows
    stream through in order; only one row waits for the next, so memory holds two texts whatever the range.

    Nulls: a null text counts as empty, rows without an id come first. Texts with no feature (under 64 bytes or
    of one byte over and over) are compared as a whole. Repeated rows follow one another and have equal
    digests. A single row follows itself; an empty table gives no rows. doc_id must be an integer; other columns
    of ``docs``, whatever their names, are neither read nor returned.
    """
    ordered = followed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).repartition("range").sortWithinPartitions("range", "extra", "place")

    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in KIND.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        waiting = None

        def finish(row: tuple, after: tuple) -> tuple:
            (_, doc_id, text, data, places, hashes, own), (_, _, following, *_, other) = row, after
            n = len(text)
            kept = text[: n - n // 4]
            edited = (kept + following[: n // 4]).encode("utf-8", "surrogatepass")
            if edited == data:
                changed = own
            else:
                sure = len(kept.encode("utf-8", "surrogatepass")) - WINDOW - AROUND
                same = int(np.searchsorted(places, sure, side="right")) if sure > 0 else 0
                fresh = features(edited, sure + 1 if sure > 0 else 0)
                changed = as_text(filters_of(np.concatenate([hashes[:same], _feature_hashes(edited, fresh)])), edited)
            return doc_id, n, hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)

        for batch in batches:
            rows = []
            for home, extra, doc_id, text in zip(*(batch.column(c) for c in ("range", "extra", "doc_id", "text")), strict=True):
                home, extra, doc_id, text = home.as_py(), extra.as_py(), doc_id.as_py(), text.as_py()
                if extra and (waiting is None or waiting[0] != home):
                    continue  # a repeat of the row that follows the range
                data = text.encode("utf-8", "surrogatepass")
                places = features(data)
                hashes = _feature_hashes(data, places)
                now = (home, doc_id, text, data, places, hashes, as_text(filters_of(hashes), data))
                if waiting is not None:
                    rows.append(finish(waiting, now))
                waiting = None if extra else now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ordered.mapInArrow(stream, KIND)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
