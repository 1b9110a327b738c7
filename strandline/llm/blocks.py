"""Documents in blocks of bounded size that later steps can meet without moving the text again, and hashing over such blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import new_folder, remove_folder

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64


class Blocks:
    """``docs`` written once as a table bucketed by ``block``; ``close()`` drops it.

    A block holds about ``block_bytes`` of text, whatever the input's size, and is what one task handles at a
    time. Rows go to blocks by a hash of id and text. Replies keyed by ``block`` join the table by a cogroup
    that reads the buckets in place: the text is shuffled only while it is written.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = 2 << 20, least: int = 1):
        spark = docs.sparkSession
        self.spark = spark
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(least, -(-total // block_bytes))
        files = min(max(self.count, int(spark.conf.get("spark.sql.shuffle.partitions"))), 20_000)
        self.name, self.folder = f"strandline_{uuid.uuid4().hex[:12]}", new_folder(spark, "blocks")
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.count)).cast("int")
        dealt = docs.withColumn("block", block).repartition(files, "block")
        dealt.write.format("parquet").option("path", self.folder).bucketBy(files, "block").saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def bits(self) -> int:
        """Leading bits of a key that name its range: ranges grow in number with the blocks, a quarter as many, so none grows with the corpus.

        A block sends a row per range that it has keys in: never more rows than keys, however many ranges there are.
        """
        return max(3, (self.count - 1).bit_length() - 2)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_folder(self.spark, self.folder)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))  # a random number for each byte


def runs(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of each stretch of the sorted keys that share their leading ``bits``; ranges without keys are left out."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.diff(part, prepend=-1))
    return [] if not len(keys) else list(zip(part[start].tolist(), start.tolist(), np.append(start[1:], len(keys)).tolist(), strict=True))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS["up"], _POWERS["down"] = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of BYTES[x[j]] * BASE**j for j < i."""
    up, _ = _powers(len(x) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[x] * up[: len(x)])])


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) from ``prefix_hashes``; equal bytes have equal hashes wherever they stand."""
    _, down = _powers(len(s))
    return mixed((s[end] - s[start]) * down[start])


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned or small numbers as planes of bytes, lowest first; ascending ones as steps. High planes are nearly all zero, which compresses away."""
    values = values.astype("<u8")
    if ascending and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    values = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _pieces(data: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    """``data`` cut at blanks into pieces near ``most`` bytes."""
    at = 0
    while at < len(data):
        end = at + most
        if end < len(data):
            ends = np.flatnonzero(BLANK[np.frombuffer(data, np.uint8, min(len(data) - end, most), end)])
            while not len(ends) and end + most < len(data):
                end += most
                ends = np.flatnonzero(BLANK[np.frombuffer(data, np.uint8, min(len(data) - end, most), end)])
            end = end + int(ends[0]) if len(ends) else len(data)
        yield data[at:end]
        at = end


END_TOKEN, START_TOKEN = np.uint64(1), np.uint64(2)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per run without blanks, ASCII case folded."""
    found = []
    for piece in _pieces(data.lower()):
        x = np.frombuffer(piece, np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[x], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            found.append(mixed(span_hashes(prefix_hashes(x), start, end) ^ (end - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def tokens(texts: list[str | None], batch: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts with an end token after each, number of tokens of each text)."""
    hashes, sizes, pending, held = [], [], [], 0

    def flush():
        # several short texts at once: the words of each follow from a blank put between them
        data = b"\n".join(pending)
        words = word_hashes(data)
        x = np.frombuffer(data.lower(), np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[x], [True]]).astype(np.int8))
        start = np.flatnonzero(edge == -1)
        ends = np.cumsum([len(p) + 1 for p in pending])
        upto = np.searchsorted(start, ends)
        counts = np.diff(upto, prepend=0)
        hashes.append(np.insert(words, upto, END_TOKEN))
        sizes.append(counts + 1)

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        pending.append(data)
        held += len(data) + 1
        if held > batch:
            flush()
            pending, held = [], 0
    if pending:
        flush()
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
