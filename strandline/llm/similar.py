"""Texts whose sets of word shingles are similar: an exact Jaccard self-join by prefixes of the sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Shelf, new_folder, remove_folder

PARITY = 1024  # bits of a set's parity sketch, at least
ROUNDS, WORTH = 3, 0.2  # of comparing with one member of the largest class, as long as that links a share WORTH of the pairs, before all pairs left; sets the cost only


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes (seed 42) of the word shingles; fewer words than ``width`` make one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def set_key(found: np.ndarray) -> int:
    """Equal sets have equal keys; 0 is the empty set."""
    return xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray, int], similarity: float) -> np.ndarray:
    """So many of the set's hashes, rare ones first, that two sets of this similarity share one of them at least.

    Two such sets share ceil(similarity * n) hashes of the n of either; all but one fewer than that are taken.
    ``common`` (``common_hashes``) comes last, in the order of its counts. Any order that all sets share will do.
    """
    n = len(found)
    take = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    hashes, counts, shift = common
    if len(hashes) and n:
        short = found >> np.uint64(shift)
        at = np.minimum(np.searchsorted(hashes, short), len(hashes) - 1)
        rank = np.where(hashes[at] == short, counts[at], 0)
    return found[np.lexsort((found, rank))[:take]]


def parity(found: np.ndarray) -> bytes:
    """Bit b tells if an odd number of hashes falls on b: two sketches differ in no more bits than the sets in hashes.

    A power of two of bits, twice the size of the set or more, so that it tells long texts apart as well as short ones.
    """
    bits = max(PARITY, 1 << (2 * len(found)).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1 == 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the size of the shorter."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_hashes(docs: DataFrame, width: int, bound: int = 1_000_000, range_bytes: int = 4 << 20, held_hashes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent hashes of all texts' sets, at most ``bound``: sorted hashes without their ``shift`` lowest bits, counts, shift.

    Every set of every text counts (equal sets that a task holds together count once). Tasks send 40 bits of each
    hash below the bits that name its range, as a block per range; there is a range for some ``range_bytes`` of text,
    so no range grows with the corpus. Hashes of two sets or more are counted there, and those above the least
    count that leaves ``bound`` of them are collected.
    """
    import pyarrow as pa

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min((size // range_bytes).bit_length(), 24)
    shift = 24 - bits

    def blocks(batches):
        held: dict[int, np.ndarray] = {}
        n = 0

        def flush():
            h = np.sort(np.concatenate(list(held.values()))) >> np.uint64(shift)
            name = (h >> np.uint64(40)).astype(np.int64)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(h)]])
            octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            sent = [octets[i:j].T.tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(name[edge[:-1]]), pa.array(sent, pa.binary())], names=["range", "hashes"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingle_set(text, width)
                if len(found) and (key := set_key(found)) not in held:
                    held[key] = found
                    n += len(found)
                if n >= held_hashes:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    def counts(sent: pd.DataFrame) -> pd.DataFrame:
        wide = [np.zeros((len(b) // 5, 8), np.uint8) for b in sent.hashes]
        for octets, block in zip(wide, sent.hashes, strict=True):
            octets[:, :5] = np.frombuffer(block, np.uint8).reshape(5, -1).T
        h, n = np.unique(np.concatenate(wide).view("<u8").ravel(), return_counts=True)
        first = np.uint64(int(sent.range.iloc[0])) << np.uint64(40)
        return pd.DataFrame({"h": (h[n > 1] | first).view(np.int64), "n": n[n > 1]})

    shelf = Shelf(docs.sparkSession)
    sent = docs.select("text").mapInArrow(blocks, "range long, hashes binary")
    counted = shelf.park(sent.groupBy("range").applyInPandas(counts, "h long, n long"), "counts")
    level = F.floor(F.log2("n") * 4)
    sizes = sorted(((r.level, r.m) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total = np.cumsum([m for _, m in sizes])
    taken = [at for (at, _), m in zip(sizes, total, strict=True) if m <= bound]
    often = counted.where(level >= taken[-1] if taken else F.lit(False)).toArrow()
    shelf.clear()
    hashes = often.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], often.column("n").to_numpy()[order], shift


def marks_udf(docs: DataFrame, width: int, similarity: float):
    """A UDF from a text to its set: key, n (size), parity sketch and prefix. One pass over the texts gives all that meetings need."""
    common = docs.sparkSession.sparkContext.broadcast(common_hashes(docs, width))

    @F.pandas_udf("key long, n int, parity binary, prefix array<long>")
    def marks(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            s = shingle_set(t, width)
            rows.append((int(np.uint64(set_key(s)).view(np.int64)), len(s), parity(s), prefix(s, common.value, similarity).view(np.int64)))
        return pd.DataFrame(rows, columns=["key", "n", "parity", "prefix"])

    return marks


def similar_classes(texts: DataFrame, width: int, similarity: float, components: Callable[[DataFrame], DataFrame], broadcast_pairs: int = 200_000) -> DataFrame:
    """(node, root) of the classes under links of pairs with at least ``similarity``; keys alone in their class may be missing.

    ``texts``: key, n, parity, prefix (``marks_udf``) and text. Sets that share a prefix hash meet, if what either
    has from it on is enough for the similarity: similar sets do so at the first hash they share. First each is
    compared with the most central of those it meets, the one with the fewest hashes rarer than the shared one:
    of copies of one text with edits of their own, the least edited, which is within reach of nearly all the others. Then,
    where a hash still joins several classes, sets outside its largest class are compared with a central member of that,
    and after ROUNDS of this with all they meet of other classes. So every pair is compared but those in one class already and those that sizes or parity
    sketches rule out. Similarity is worked out from whole texts. Up to ``broadcast_pairs`` pairs, their keys and
    roots (some 30 bytes a pair) are broadcast to meet texts and meetings; beyond, they meet by a shuffle. Meetings
    are written once in buckets of their hash, so that no turn shuffles them again.
    """
    spark = texts.sparkSession
    shelf = Shelf(spark)
    park = shelf.park

    @F.pandas_udf("boolean")
    def near(text: pd.Series, other: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        out = []
        for a, b in zip(text, other, strict=True):
            if len(known) > 64:
                known.clear()
            x, y = (known[t] if t in known else known.setdefault(t, shingle_set(t, width)) for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def may(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        apart = np.array([sketch_distance(x, y) for x, y in zip(a, b, strict=True)], float)
        return pd.Series(apart <= (1 - similarity) / (1 + similarity) * (n + m).to_numpy() + 1e-9)

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are similar."""
        side = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
        left = pairs.join(side("a"), "a").join(side("b"), "b").where(may("n_a", "n_b", "p_a", "p_b")).select("a", "b")
        left = park(left, "pairs")
        need = left.select(F.col("a").alias("key")).union(left.select(F.col("b").alias("key"))).distinct()
        if left.count() <= broadcast_pairs:
            need = F.broadcast(need)
        held = park(texts.join(need, "key").dropDuplicates(["key"]), "held")
        whole = left.join(held.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        found.append(park(whole.where(near("ta", "tb")).select("a", "b"), "links"))
        shelf.clear(sketches, *found)
        return found[-1]

    many = texts.agg(F.sum(F.size("prefix"))).first()[0] or 0
    files = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // 2_000_000)), 20_000)
    name, folder = f"strandline_{uuid.uuid4().hex[:12]}", new_folder(spark, "meetings")
    dealt = texts.where("key <> 0").select("key", "n", F.posexplode("prefix").alias("at", "h")).repartition(files, "h").transform(_meetings)
    dealt.write.format("parquet").option("path", folder).bucketBy(files, "h").saveAsTable(name)
    met = spark.table(name)
    joined = met.select("key").distinct()
    sketches = park(texts.select("key", "n", "parity").join(joined, "key").dropDuplicates(["key"]), "sketches")

    def fits(n: str, at: str, m: str, other: str) -> Column:
        """Sizes and places in the order of two sets that meet allow the similarity."""
        n, at, m, other = (F.col(c) for c in (n, at, m, other))
        return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (F.least(n - at, m - other) >= similarity / (1 + similarity) * (n + m) - 1e-9)

    stars = met.where("key <> leader").where(fits("n", "at", "m", "leader_at")).select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    found: list[DataFrame] = []
    links = checked(stars)
    turn = 0
    while turn <= ROUNDS:
        roots = components(links)
        roots = F.broadcast(roots) if links.count() <= broadcast_pairs else roots
        placed = met.select("h", "key", "n", "at").join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "n", "at", F.coalesce("root", "key").alias("root"))
        each = placed.groupBy("h", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.col("at").alias("rare"), F.xxhash64("key", F.lit(turn)), "key", "n", "at")).alias("one"))
        largest = each.groupBy("h").agg(F.max(F.struct("c", "root", "one")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
        placed = placed.join(largest.select("h", F.col("main.root").alias("main"), F.col("main.one.key").alias("b"), F.col("main.one.n").alias("nb"), F.col("main.one.at").alias("at_b")), "h")
        few = placed.where("root <> main").withColumnRenamed("key", "a")
        pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        if turn < ROUNDS:
            pairs = park(few.where(fits("n", "at", "nb", "at_b")).select(*pair("a", "b")).distinct(), "turn")
            tried = pairs.count()
            more = checked(pairs)
            links = links.union(more)
            turn = turn + 1 if more.count() > WORTH * tried else ROUNDS
        else:
            few = few.select("h", "a", F.col("n").alias("na"), F.col("at").alias("at_a"), F.col("root").alias("ra"))
            apart = (F.col("ra") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("key")))
            links = links.union(checked(few.join(placed, "h").where(apart & fits("na", "at_a", "n", "at")).select(*pair("a", "key")).distinct()))
            turn += 1
    out = components(links)
    shelf.clear()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_folder(spark, folder)
    return out


def _meetings(rows: DataFrame) -> DataFrame:
    """Rows (key, n, at, h) whose h several keys have, once each, with key, size and place of the one with the fewest rarer hashes: ``leader``, ``m``, ``leader_at``."""
    from pyspark.sql import Window

    w = Window.partitionBy("h").orderBy("at", "n", "key")
    first = [F.first(c).over(w).alias(to) for c, to in (("key", "leader"), ("n", "m"), ("at", "leader_at"))]
    rows = rows.select("h", "key", "n", "at", *first, F.lead("key").over(w).alias("next"))
    last = F.col("next").isNull() | (F.col("next") != F.col("key"))  # of the equal rows
    return rows.where(last & ((F.col("key") != F.col("leader")) | F.col("next").isNotNull())).drop("next")
