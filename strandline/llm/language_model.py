"""Language-model scoring by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.blocks import START_TOKEN, Blocks, mixed, packed, runs, tokens, unpacked
from strandline.llm.common import fold, new_folder, park, remove_folder, table

BUCKETS = 24  # context-frequency buckets: powers of two
LEAST_BLOCKS = 8  # held out one at a time


def _grams(texts: list[str | None]):
    """(word hashes, hashes of (previous word, word), hash of the previous word, tokens of each text)."""
    word, sizes = tokens(texts)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = START_TOKEN
    return word, mixed(mixed(before) * np.uint64(3) + word), before, sizes


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each key among them, how many of each are learned from)."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, np.bincount(place[learn], minlength=len(distinct))


def _ship(bits: int):
    """Of a block: its distinct words (n 1) and word pairs (n 2) with its own counts, a packed row per key range."""

    def ship(block):
        import pyarrow as pa

        word, pair, _, sizes = _grams(block["text"].to_pylist())
        learn, number = np.repeat(block["learn"].to_numpy(zero_copy_only=False), sizes), block["block"][0].as_py()
        rows = []
        for n, keys in ((1, word), (2, pair)):
            distinct, _, own = _counted(keys, learn)
            rows += [(n, part, number, packed(distinct[a:b], ascending=True), packed(own[a:b])) for part, a, b in runs(distinct, bits)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["n", "part", "block", "keys", "own"])

    return ship


def _sum_up(part):
    """Of a key range: total counts back to each block, only where they differ from its own; and a row of its sums (block -1)."""
    import pyarrow as pa

    n, number = part["n"][0].as_py(), part["part"][0].as_py()
    blocks = part["block"].to_pylist()
    keys = [unpacked(x.as_py(), ascending=True) for x in part["keys"]]
    own = np.concatenate([unpacked(x.as_py()) for x in part["own"]]).astype(np.int64)
    sizes = [len(k) for k in keys]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(place, own, len(distinct)).astype(np.int64)
    every = total[place]
    rows, at = [], 0
    for block, size in zip(blocks, sizes, strict=True):
        here = np.flatnonzero(every[at : at + size] != own[at : at + size])
        if len(here):
            rows.append((n, number, block, packed(here, ascending=True), packed(every[at : at + size][here]), 0, 0))
        at += size
    rows.append((n, number, -1, b"", b"", int(total.sum()), int((total > 0).sum())))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["n", "part", "block", "at", "total", "tokens", "types"])


REPLY = "n int, part long, block int, at binary, total binary, tokens long, types long"


class _Counts:
    """A block's tokens with counts over all documents and, where held out, over all other blocks."""

    def __init__(self, block, replies, bits: int, starts: int, held_out: bool):
        word, pair, before, self.sizes = _grams(block["text"].to_pylist())
        learn_docs = block["learn"].to_numpy(zero_copy_only=False)
        self.learn = np.repeat(learn_docs, self.sizes)
        by: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        for n, part, at, total in zip(*(replies[c].to_pylist() for c in ("n", "part", "at", "total")), strict=True):
            by[n, part] = (at, total)
        first = before == START_TOKEN
        words, place, counts = self._look_up(1, word, by, bits, held_out)
        self.word = counts[place]
        # the word before is the text's start or a word of this block
        place = np.minimum(np.searchsorted(words, before), max(len(words) - 1, 0))
        starts -= int(learn_docs.sum()) if held_out else 0
        self.context = np.where(first, starts, counts[place] if len(words) else 0)
        del word, before, words, place
        _, place, counts = self._look_up(2, pair, by, bits, held_out)
        self.pair = counts[place]
        self.own_tokens = int(self.learn.sum())

    def _look_up(self, n: int, keys: np.ndarray, by: dict, bits: int, held_out: bool):
        """(distinct keys, place of each key among them, counts: of all documents or, ``held_out``, of all other blocks)."""
        distinct, place, own = _counted(keys, self.learn)
        total = own.astype(np.int64)
        for part, a, _ in runs(distinct, bits):
            if (n, part) in by:
                at, values = by[n, part]
                total[a + unpacked(at, ascending=True).astype(np.int64)] = unpacked(values).astype(np.int64)
        return distinct, place, total - own if held_out else total


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)  # 0: never seen, then 1, 2-3, 4-7 ...


def learn_weights(cells: list[tuple[int, int, int, int]], unseen: float, rounds: int = 200) -> np.ndarray:
    """Weights of (pair, word, uniform) by bucket, from counts of held-out tokens by (bucket, pair and word estimate in 1/16 log10)."""
    if not cells:
        return np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    b, q2, q1, n = (np.array(c, float) for c in zip(*cells, strict=True))
    b = b.astype(int)
    value = lambda q: np.where(q > 0, 0.0, 10.0 ** (q / 16))  # noqa: E731  1 stands for an estimate of zero
    p = np.stack([value(q2), value(q1), np.full(len(b), unseen)], axis=1)
    start = np.array([0.3, 0.4, 0.3])
    out = np.tile(start, (BUCKETS + 1, 1))
    for _ in range(rounds):
        for which, at in ((b, slice(0, BUCKETS)), (np.full(len(b), BUCKETS), slice(BUCKETS, None))):
            w = out[which] * p
            w *= (n / w.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(which, w[:, k], BUCKETS + 1) for k in range(3)], axis=1)[at]
            full = sums.sum(axis=1) > 0
            out[at][full] = sums[full] / sums[full].sum(axis=1, keepdims=True)
    seen = np.bincount(b, n, BUCKETS) > 0
    out[:BUCKETS][~seen] = out[BUCKETS]
    out = np.maximum(out[:BUCKETS], [0.0, 0.0, 1e-6])
    return out / out.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, learn: F.Column, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` (doc_id, text) with n_tokens, n_known, train_tokens, base_score and score; learned from rows where ``learn`` holds.

    score: log10 of the product over tokens of a*c(v,w)/c(v) + b*c(w)/N + c/(V+1), v the word before, with
    weights by the context's frequency. The weights come from expectation-maximisation on held-out counts: each block
    of documents is scored with the counts of all other blocks.

    Words and pairs are 64-bit hashes of the whole texts. Each block sends its distinct keys with counts, packed
    by key range; each key range sums them and answers a block only where the sum differs from the block's own
    count. So common words travel once per block, not once per use, and no key range grows with a word's frequency.
    The tables of counts grow with the corpus and stay on the executors.

    Nulls: a null text is an empty one, whose only token is its end. Rows without an id are not learned from.
    Repeated rows score alike. An empty table gives no rows; with nothing to learn from, N and V are 0. Other
    columns of ``docs``, whatever their names, are not returned.
    """
    spark = docs.sparkSession
    blocks = Blocks(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn")), block_bytes, LEAST_BLOCKS)
    bits = blocks.bits
    shipped = blocks.table.groupBy("block").applyInArrow(_ship(bits), "n int, part long, block int, keys binary, own binary")
    folder = new_folder(spark, "replies")
    shipped.groupBy("n", "part").applyInArrow(_sum_up, REPLY).write.parquet(folder)
    replies = spark.read.schema(REPLY).parquet(folder)
    sums = replies.where("block = -1 and n = 1").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = int(sums[0] or 0), int(sums[1] or 0)
    starts = blocks.table.where("learn").count()
    answers = replies.where("block >= 0").drop("tokens", "types")
    met = blocks.table.groupBy("block").cogroup(answers.groupBy("block"))

    def held_out(block, replies):
        import pyarrow as pa

        c = _Counts(block, replies, bits, starts, True)
        rest = max(n_tokens - c.own_tokens, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = lambda p: np.where(p > 0, np.rint(16 * np.log10(np.where(p > 0, p, 1))), 1)
            q2 = log(np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0.0))
            q1 = log(c.word / rest)
        cells = np.stack([_bucket(c.context), q2, q1], axis=1)[c.learn].astype(np.int64)
        packed = (cells[:, 0] << 40) + ((cells[:, 1] + 1000) << 20) + cells[:, 2] + 1000
        cell, n = np.unique(packed, return_counts=True)
        return pa.table([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    cells = met.applyInArrow(held_out, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most buckets x grid
    unpacked = [(r.cell >> 40, ((r.cell >> 20) & 0xFFFFF) - 1000, (r.cell & 0xFFFFF) - 1000, r.n) for r in cells]
    weights = learn_weights(sorted(unpacked), 1 / (n_types + 1))

    def score(block, replies):
        import pyarrow as pa

        c = _Counts(block, replies, bits, starts, False)
        doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
        per_doc = lambda x: np.bincount(doc, x, len(c.sizes))
        base = np.log10((c.word + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        w = weights[_bucket(c.context)]
        p = w[:, 0] * c.pair / np.maximum(c.context, 1) + w[:, 1] * c.word / max(n_tokens, 1) + w[:, 2] / (n_types + 1)
        columns = [block["doc_id"], pa.array(c.sizes), pa.array(per_doc(c.word > 0).astype(np.int64)), pa.array(np.full(len(c.sizes), n_tokens)), pa.array(per_doc(base)), pa.array(per_doc(np.log10(p)))]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = park(met.applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    blocks.close()
    remove_folder(spark, folder)
    return out


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, ~fold(F.col("doc_id"), 5).isin(1, -1))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
