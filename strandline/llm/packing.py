"""Packing of tokenised documents into sequences of bounded length and balanced cost."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import other_columns, table

#: Of these characters normal forms, blanks and cases are plain: printable ASCII, Latin letters that have a form of their own in either case, some marks.
SIMPLE = "!-~À-ÖØ-öø-įı-ſ«»“”„‘’–—…§°"
ODD = re.compile(f"[^{SIMPLE} \\t-\\r]")
#: How the vocabulary's own pattern splits texts of such characters in lower case; it is in the tokenizer's file, for all of Unicode.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[^a-z0-9ß-öø-įı-ſ \\t-\\r]+")


class Encoder:
    """Ids of whole texts, as the tokenizer in ``path`` gives them.

    No piece of this vocabulary crosses a blank, and what stands between blanks has the same ids wherever it stands.
    Runs of simple characters are split into pieces here, and a piece meets the pair merges once, while it is among
    ``most`` known ones. A run with any other character is left to the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.odd = re.compile("|".join([ODD.pattern, *[re.escape(t["content"]) for t in spec["added_tokens"]]]))
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        self.known: dict[str, bytes] = {}
        self.most = most

    def _simple(self, text: str) -> bytes:
        pieces = PIECES.findall(text.lower())
        fresh = list(set(pieces).difference(self.known))
        if fresh:
            if len(self.known) > self.most:
                self.known.clear()
                fresh = list(set(pieces))
            found = self.merges.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(fresh))) * 4).tolist()
            self.known.update(zip(fresh, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        return b"".join(map(self.known.__getitem__, pieces))

    def _mixed(self, text: str) -> bytes:
        """Stretches of simple runs one way, those of others the other way."""
        out, at = [], 0
        runs = [m for m in re.finditer("[^ \\t-\\r]+", text) if self.odd.search(text, *m.span())]
        for m in runs:
            out.append(self._simple(text[at : m.start()]))
            out.append(m)
            at = m.end()
        out.append(self._simple(text[at:]))
        ids = iter(self.whole.encode_batch_fast([m[0] for m in runs], add_special_tokens=False))
        return b"".join([x if isinstance(x, bytes) else np.array(next(ids).ids, "<u4").tobytes() for x in out])

    def encode(self, data: bytes, most: int = 1 << 20) -> bytes:
        """Ids as unsigned little-endian numbers of 32 bits; long texts are cut at blanks, so that only their ids are held whole."""
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > most:
                blank = re.compile(rb"[ \t-\r]").search(data, at + most)
                end = blank.start() if blank else end
            text = data[at:end].decode("utf-8", "replace")
            out.append(self._mixed(text) if self.odd.search(text) else self._simple(text))
            at = end
        return b"".join(out)


def lengths_without_padding(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of sequences that ``tokens`` fill exactly: full ones, then powers of two, which need no padding."""
    full, rest = divmod(tokens, capacity)
    return np.array([capacity] * full + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1], np.int64)


def balance(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of pieces: each document, longest first, goes to the sequence of least cost that has room for it.

    A piece costs linear * length + quadratic * length^2: attention runs inside a document. Where no sequence has room for the
    whole, the one of most room takes what it can and the rest is placed in the same way. All sequences end up full.
    """
    room = lengths_without_padding(int(sizes.sum()), capacity)
    cost = np.zeros(len(room))
    out = []
    for doc in np.argsort(-sizes, kind="stable").tolist():
        at, left = 0, int(sizes[doc])
        while left:
            fits = room >= left
            to = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[to]))
            out.append((doc, at, n, to))
            room[to] -= n
            cost[to] += linear * n + quadratic * n * n
            at, left = at + n, left - n
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 4096, block_tokens: int = 1 << 20, path: str | None = None) -> DataFrame:
    """A row per piece of a document: its other columns and (start, length, doc_tokens, sequence_id, offset, ids).

    A document is its text's ids and then ``end_id``; ``ids`` holds a piece's, as little-endian numbers of 32 bits.
    Full stretches of ``capacity`` ids are sequences of their own. What remains of each document is packed with
    others in blocks of about ``block_tokens`` ids: longest first, each to the sequence of least cost with room for
    it (``balance``). A block's sequences are as long as full ones, but for at most one of each smaller power of two,
    which isn't padded either; so there is no padding, and a block cuts no more documents than it has sequences, about.

    A block is a stretch of rows as they lie in the input: nothing is shuffled, texts are read once, and a task holds
    one block whatever the input's size. So the packing follows the order of rows in the input's files and their splits;
    sequence_id is unique (the task's number in the high bits) but not gapless. A task that runs again gives the same.

    ``path`` is the tokenizer's file, on every executor (by default that of the installed package).
    ``capacity`` must be a power of two. Nulls: a null text is empty, its ids are ``end_id`` alone; a null doc_id is
    one like any other. Repeated rows are packed each; an empty table gives no rows. Columns of the input with the
    names of the result, and its text, in any case, are left out.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    added = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    own = other_columns(docs, "text", *[n for n, _ in added], prefix="_pk_")
    out = T.StructType([*[docs.schema[c] for c in own], *[T.StructField(n, kind) for n, kind in added]])
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, sequence = Encoder(path), TaskContext.get().partitionId() << 36
        rows, ids, held = [], [], 0  # of the block so far: slices of other columns, ids of each document

        def block():
            nonlocal sequence
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            full = sizes // capacity
            pieces = [(d, c * capacity, capacity, s) for s, (d, c) in enumerate((d, c) for d in np.flatnonzero(full).tolist() for c in range(int(full[d])))]
            first = sequence + len(pieces)
            pieces = [(d, at, n, sequence + s, 0) for d, at, n, s in pieces]
            used: dict[int, int] = {}
            for d, at, n, s in balance(sizes - full * capacity, capacity, linear, quadratic):
                pieces.append((d, at + int(full[d]) * capacity, n, first + s, used.get(s, 0)))
                used[s] = used.get(s, 0) + n
            sequence = first + len(used)
            columns = pa.Table.from_batches(rows).take(pa.array([p[0] for p in pieces], pa.int64()))
            numbers = ([p[1] for p in pieces], [p[2] for p in pieces], [int(sizes[p[0]]) for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces])
            cut = pa.array([ids[d][at * 4 : (at + n) * 4] for d, at, n, _, _ in pieces], pa.binary())
            made = pa.table([*[columns[c] for c in own], *[pa.array(x, pa.int64()) for x in numbers], cut], names=[*own, *[n for n, _ in added]])
            yield from made.to_batches(max_chunksize=5000)

        for batch in batches:
            at = 0
            for i, text in enumerate(batch["_pk_text"]):
                ids.append(encoder.encode(text.as_py() or b"") + end)
                held += len(ids[-1]) // 4
                if held >= block_tokens or i + 1 == batch.num_rows:
                    rows.append(batch.slice(at, i + 1 - at))
                    at = i + 1
                if held >= block_tokens:
                    yield from block()
                    rows, ids, held = [], [], 0
        if ids:
            yield from block()

    return docs.select(*own, F.col("text").cast("string").cast("binary").alias("_pk_text")).mapInArrow(packed, out)


def sequences(pieces: DataFrame) -> DataFrame:
    """A row per sequence: its id, number of ids, number of pieces, and all ids in order (little-endian numbers of 32 bits)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.count("*").alias("n_pieces"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n_ids", "n_pieces", joined.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
