"""Exact removal of repeated byte strings across documents, by prefix-free parsing.

A rolling hash of 16 bytes triggers where it is least among the 35 that a 50-byte string holds, so every 50-byte
string has a trigger and equal strings have theirs at the same place. Triggers cut texts into phrases; no phrase
is the beginning of another, since a trigger stands at its end and nowhere before. The dictionary of trigger grams
of all documents shows which phrase ends can recur at all. For those, two suffix orders are built per range of the
dictionary: of the phrases that end there, read backwards from the trigger (their suffixes of every length lie
together), and of what the parse has after it. Common prefixes of neighbours in both orders tell which phrase
suffixes are equal and which continuations are. A 50-byte string is a suffix of some length and its continuation, so
equal strings are those equal in both, and the smallest doc_id of each takes precedence. Orders compare bytes, not
hashes, except for hot grams (``MANY``), whose strings meet by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandline.llm.blocks import BASE, BYTES, Blocks, mixed, prefix_hashes, runs, span_hashes
from strandline.llm.common import new_folder, park, remove_folder, table

SPAN, GRAM = 50, 16
BACK = SPAN - GRAM  # a string begins at most so far before its trigger
WIDTH = BACK + SPAN  # bytes around a trigger that its strings can hold
SEGMENT = 1 << 19
MANY = 32  # documents of one block that hold the same gram: a hot gram; so is one that 8 * MANY blocks hold

STATUS, MASKS, LEAST = 1, 2, 3
REPLY = "kind int, part long, block int, data binary"


def _table(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["kind", "part", "block", "data"])


def triggers(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the triggers of all strings that begin where ``inside`` holds."""
    places, grams = [], []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(x), SEGMENT):
        piece = x[at : at + SEGMENT + SPAN - 1]
        n = len(piece) - GRAM + 1
        if len(piece) < SPAN:
            break
        i = np.arange(n)
        h = span_hashes(prefix_hashes(piece), i, i + GRAM)
        key = (h & ~low) | i.astype(np.uint64)  # the first of equal hashes
        least = key
        for step in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-step], least[step:])
        rest = BACK + 1 - 32
        least = np.minimum(least[:-rest], least[rest:])
        chosen = np.zeros(n, bool)
        chosen[(least[inside[at : at + len(least)]] & low).astype(np.int64)] = True
        here = np.flatnonzero(chosen)
        places.append(here + at)
        grams.append(h[here])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, grams = np.concatenate(places), np.concatenate(grams)
    places, first = np.unique(places, return_index=True)  # segments overlap
    return places, grams[first]


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of bytes in lexicographic order, equal ones as they came, and how many leading bytes each shares with the one before."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1]) if n else np.zeros(0, np.int64)
    common = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):
        differ = rows[order[at : at + (1 << 16)]] != rows[order[at - 1 : at - 1 + len(order[at : at + (1 << 16)])]]
        common[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


class _Block:
    """The texts of a block as one byte array, its triggers, and the dictionary of their grams."""

    def __init__(self, block):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in block["text"].to_pylist()]
        self.ids = block["doc_id"].to_pylist()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.bytes = b"".join(texts)
        self.x = np.frombuffer(self.bytes, np.uint8)
        inside = np.zeros(len(self.x), bool)
        for doc_id, s, e in zip(self.ids, self.starts.tolist(), self.ends.tolist(), strict=True):
            if doc_id is not None:
                inside[s : max(s, e - SPAN + 1)] = True
        self.at, grams = triggers(self.x, inside)
        self.row = np.searchsorted(self.ends, self.at, side="right")
        self.doc = np.array([i or 0 for i in self.ids], np.int64)[self.row] if len(self.at) else np.zeros(0, np.int64)
        # triggers are the least hashes of their strings and crowd at zero: mixed once more, they spread evenly over key ranges;
        # two bits make room for what the block knows of a gram
        self.grams, self.gram = np.unique(mixed(grams) >> np.uint64(2), return_inverse=True)

    def dictionary(self, bits: int, number: int) -> list[tuple]:
        """Rows of the grams in order; their low bits say whether two documents, or MANY, hold one."""
        order = np.lexsort((self.doc, self.gram))
        gram, doc = self.gram[order], self.doc[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        docs = np.bincount(gram[new], minlength=len(self.grams))
        keys = (self.grams << np.uint64(2)) | (docs > 1).astype(np.uint64) | ((docs >= MANY).astype(np.uint64) << np.uint64(1))
        return [(STATUS, part, number, keys[a:b].tobytes()) for part, a, b in runs(keys, bits)]

    def hear(self, statuses: dict[int, bytes], bits: int) -> None:
        """Keep the triggers whose grams other documents hold, and one for all that have the same bytes around them."""
        status = np.zeros(len(self.grams), np.uint8)
        for part, a, b in runs(self.grams << np.uint64(2), bits):
            if part in statuses:
                status[a:b] = np.frombuffer(statuses[part], np.uint8)
        kept = np.flatnonzero(status[self.gram] > 0)
        kept = kept[np.lexsort((self.at[kept], self.doc[kept]))]
        self.at, self.row, self.doc, self.gram = self.at[kept], self.row[kept], self.doc[kept], self.gram[kept]
        self.hot = status[self.gram] == 2
        self.left = np.minimum(BACK, self.at - self.starts[self.row])
        self.right = np.minimum(SPAN, self.ends[self.row] - self.at)
        around = np.empty((len(kept), WIDTH + 2), np.uint8)
        around[:, 0], around[:, 1] = self.left, self.right
        for a in range(0, len(kept), 1 << 14):
            around[a : a + (1 << 14), 2:] = self._context(slice(a, a + (1 << 14)))
        order, common = suffix_order(around)
        first = common < WIDTH + 2
        first[:1] = True
        self.model = np.empty_like(order)  # for each trigger the first one with the same bytes around it, in the least document
        self.model[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        own = np.flatnonzero(self.model == np.arange(len(order)))
        by_gram = own[np.argsort(self.grams[self.gram[own]], kind="stable")]
        self.usual, self.special = by_gram[~self.hot[by_gram]], by_gram[self.hot[by_gram]]

    def _context(self, rows) -> np.ndarray:
        at = self.at[rows]
        offset = np.arange(-BACK, SPAN, dtype=np.int32)
        held = (offset >= -self.left[rows][:, None]) & (offset < self.right[rows][:, None])
        return np.where(held, self.x[np.clip(at.astype(np.int32)[:, None] + offset, 0, max(len(self.x) - 1, 0))], 0)

    def usual_runs(self, bits: int) -> list[tuple[int, int, int]]:
        return runs(self.grams[self.gram[self.usual]] << np.uint64(2), bits)

    def usual_rows(self, bits: int, number: int) -> list[tuple]:
        rows = []
        for part, a, b in self.usual_runs(bits):
            some = self.usual[a:b]
            head = self.doc[some].tobytes() + self.left[some].astype(np.uint8).tobytes() + self.right[some].astype(np.uint8).tobytes()
            rows.append((MASKS, part, number, head + self._context(some).tobytes()))
        return rows

    def special_strings(self):
        """(which places of each hot trigger are strings, their distinct hashes, place of each among them, least id of each)."""
        hashes, whole = strings(self._context(self.special), self.left[self.special], self.right[self.special])
        distinct, place = np.unique(hashes[whole], return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, place, np.broadcast_to(self.doc[self.special][:, None], whole.shape)[whole])
        return whole, distinct, place, least

    def special_rows(self, bits: int, number: int) -> list[tuple]:
        if not len(self.special):
            return []
        _, distinct, _, least = self.special_strings()
        return [(LEAST, part, number, distinct[a:b].tobytes() + least[a:b].tobytes()) for part, a, b in runs(distinct, bits)]


def strings(context: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each 50-byte string around a trigger, by how far before it the string begins; and which of them the text holds."""
    n, k = len(context), BACK + 1
    out = np.empty((n, k), np.uint64)
    power = np.uint64(pow(BASE, SPAN, 1 << 64))
    for a in range(0, n, 1 << 13):
        part = context[a : a + (1 << 13)]
        h = np.zeros((WIDTH + 1, len(part)), np.uint64)
        for c in range(WIDTH):
            h[c + 1] = h[c] * np.uint64(BASE) + BYTES[part[:, c]]
        out[a : a + (1 << 13)] = mixed(h[SPAN:] - h[:k] * power)[::-1].T
    return out, whole_strings(left, right)


def whole_strings(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    back = np.arange(BACK + 1)
    return (back <= left[:, None]) & (SPAN - back <= right[:, None])


def repeated(doc: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of each trigger, bit b: a smaller doc holds the string that begins b bytes before it.

    The string is the phrase suffix of b bytes and SPAN - b bytes of what follows: two places in the suffix orders.
    """
    by_doc = np.argsort(doc, kind="stable")
    doc, context, whole = doc[by_doc], context[by_doc], whole_strings(left[by_doc], right[by_doc])
    n = len(doc)
    phrases, phrase_common = suffix_order(context[:, :BACK][:, ::-1])
    follows, follow_common = suffix_order(context[:, BACK:])
    masks, suffix, after = np.zeros(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(BACK + 1):
        suffix[phrases] = np.cumsum(phrase_common < back)
        after[follows] = np.cumsum(follow_common < SPAN - back)
        some = np.flatnonzero(whole[:, back])
        _, first, place = np.unique(suffix[some] * (n + 1) + after[some], return_index=True, return_inverse=True)
        least = doc[some[first]][place]  # ids ascend, so the first of equal strings is the least document's
        masks[some[least < doc[some]]] |= np.uint64(1 << back)
    out = np.empty(n, np.uint64)
    out[by_doc] = masks
    return out


def _meet(part):
    """A key range of the dictionary, or of contexts or hot strings, from all blocks: what each block needs to know of its rows."""
    kind, number = part["kind"][0].as_py(), part["part"][0].as_py()
    blocks, data = part["block"].to_pylist(), part["data"].to_pylist()
    if kind == STATUS:
        sizes = [len(d) // 8 for d in data]
        every = np.concatenate([np.frombuffer(d, "<u8") for d in data])
        distinct, place, holders = np.unique(every >> np.uint64(2), return_inverse=True, return_counts=True)
        flag = lambda bit: np.bincount(place, (every >> np.uint64(bit)) & np.uint64(1), len(distinct)) > 0
        answer = np.where(flag(1) | (holders > 8 * MANY), 2, (flag(0) | (holders > 1)).astype(int)).astype(np.uint8)[place]
    elif kind == MASKS:
        sizes = [len(d) // (8 + 2 + WIDTH) for d in data]
        each = list(zip(data, sizes, strict=True))
        doc = np.concatenate([np.frombuffer(d, "<i8", n) for d, n in each])
        left, right = (np.concatenate([np.frombuffer(d, np.uint8, n, 8 * n + k * n) for d, n in each]) for k in (0, 1))
        context = np.concatenate([np.frombuffer(d, np.uint8, n * WIDTH, 10 * n).reshape(n, WIDTH) for d, n in each])
        answer = repeated(doc, left, right, context)
    else:
        sizes = [len(d) // 16 for d in data]
        each = list(zip(data, sizes, strict=True))
        distinct, place = np.unique(np.concatenate([np.frombuffer(d, "<u8", n) for d, n in each]), return_inverse=True)
        answer = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(answer, place, np.concatenate([np.frombuffer(d, "<i8", n, 8 * n) for d, n in each]))
        answer = answer[place]
    ends = np.cumsum(sizes).tolist()
    return _table([(kind, number, block, answer[end - n : end].tobytes()) for block, n, end in zip(blocks, sizes, ends, strict=True)])


def _by_kind(replies) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {STATUS: {}, MASKS: {}, LEAST: {}}
    for kind, part, data in zip(*(replies[c].to_pylist() for c in ("kind", "part", "data")), strict=True):
        out[kind][part] = data
    return out


KIND = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def remove_repeats(docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id and KIND, the byte spans that a smaller doc_id's text holds too.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are
    judged on the input. The method is in the module's text.

    The text is written once in bucketed blocks. Blocks exchange packed arrays by key range: gram hashes, then
    84 bytes around each trigger whose gram recurs (once per block for equal bytes). Grams that very many
    documents hold are exchanged as hashes of their strings with the least id of each block, so a passage in
    a third of all documents brings no more than a row per block and string to any task.

    Ids are whole numbers, as texts are judged by the smaller id; others are an error before anything is written.
    Nulls: a null text is empty; a row without an id loses nothing and removes nothing. Texts under 50
    bytes stay whole. Rows that repeat an id don't remove each other's bytes. An empty table gives no rows.
    Other columns of ``docs``, whatever their names, are not read and not returned.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    blocks = Blocks(docs.select("doc_id", "text"), block_bytes)
    bits = blocks.bits

    def dictionary(block):
        return _table(_Block(block).dictionary(bits, block["block"][0].as_py()))

    def contexts(block, replies):
        number, b = (block["block"][0].as_py() if block.num_rows else -1), _Block(block)
        b.hear(_by_kind(replies)[STATUS], bits)
        return _table(b.usual_rows(bits, number) + b.special_rows(bits, number))

    folder = new_folder(spark, "repeats")
    read = spark.read.schema(REPLY)
    blocks.table.groupBy("block").applyInArrow(dictionary, REPLY).groupBy("kind", "part").applyInArrow(_meet, REPLY).write.parquet(f"{folder}/dictionary")
    heard = read.parquet(f"{folder}/dictionary")
    sent = blocks.table.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(contexts, REPLY)
    sent.groupBy("kind", "part").applyInArrow(_meet, REPLY).write.parquet(f"{folder}/order")
    heard = heard.union(read.parquet(f"{folder}/order"))

    def finish(block, replies):
        import pyarrow as pa

        b, told = _Block(block), _by_kind(replies)
        b.hear(told[STATUS], bits)
        masks = np.zeros(len(b.at), np.uint64)
        for part, start, end in b.usual_runs(bits):
            if part in told[MASKS]:
                masks[b.usual[start:end]] = np.frombuffer(told[MASKS][part], "<u8")
        if len(b.special):
            whole, distinct, place, least = b.special_strings()
            for part, start, end in runs(distinct, bits):
                least[start:end] = np.frombuffer(told[LEAST][part], "<i8")
            found = np.zeros(whole.shape, bool)
            found[whole] = least[place] < np.broadcast_to(b.doc[b.special][:, None], whole.shape)[whole]
            masks[b.special] = (found.astype(np.uint64) << np.arange(BACK + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        # triggers with the bytes of an earlier document around them: all their strings; of the same document: what the first has
        earlier = b.doc[b.model] < b.doc
        masks = np.where(earlier, np.uint64((1 << (BACK + 1)) - 1), masks[b.model])
        begins = np.zeros(len(b.x) + 1, bool)
        for back in range(BACK + 1):
            hit = ((masks >> np.uint64(back)) & np.uint64(1)).astype(bool) & (back <= b.left) & (SPAN - back <= b.right)
            begins[b.at[hit] - back] = True
        run = np.cumsum(begins[:-1], dtype=np.int64)
        run[SPAN:] -= run[:-SPAN].copy()
        gone = run > 0
        rows = []
        for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
            own = gone[s:e]
            if own.any():
                edge = np.diff(np.concatenate([[0], own, [0]]).astype(np.int8))
                spans = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                kept = b.x[s:e][~own].tobytes()
            else:
                spans, kept = [], b.bytes[s:e]
            rows.append((e - s, e - s - len(kept), len(spans), spans, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
        return pa.table([block["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = park(blocks.table.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, {KIND}"), "kept")
    blocks.close()
    remove_folder(spark, folder)
    return out


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
