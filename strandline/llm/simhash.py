"""SimHash near-duplicate groups: 64-bit fingerprints, a binary trie self-join under a Hamming budget, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import arrow_batches, new_folder, other_columns, park, remove_folder, table
from strandline.llm.similar import marks_udf, similar_classes

BITS = 64


def fingerprint(text: str | None, width: int = 4, chunk: int = 1 << 16) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        span = zip(starts[at : min(at + chunk, n)].tolist(), ends[at + width - 1 : min(at + chunk, n) + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in span], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(BITS) if 2 * ones[b] > n))


def fingerprint_udf(width: int):
    @F.pandas_udf(T.LongType())
    def fingerprints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in text], np.uint64).view(np.int64))

    return fingerprints


def part_edges(budget: int) -> list[int]:
    """Edges of budget + 1 parts of the bits: two values within the budget agree in one part at least."""
    return [round(i * BITS / (budget + 1)) for i in range(budget + 2)]


def merged(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of u[i] and v[i]; a label is the least index of its class."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


class TrieJoin:
    """Classes under links within the budget among values of binary tries, by walking pairs of their nodes together.

    ``values`` holds the leaves of one or more tries, those of a trie in ascending order one after another; a node
    is a range of them that share their leading bits. A pair of nodes has used up as many bits of the budget as
    their paths differ in. Each step goes down one bit on both sides, adds the bit where the sides part, and drops
    the pair once the budget is spent, or when all its values are of one class already. Many pairs step at once:
    the walk takes ``wave`` pairs of one depth at a time, the deepest first. Pairs of up to ``leaf`` combinations
    are compared directly. ``walked`` counts node pairs taken apart, ``pruned`` those that ran out of budget.
    """

    def __init__(self, values: np.ndarray, budget: int, leaf: int = 32, wave: int = 1 << 16):
        self.values, self.budget, self.leaf, self.wave = values, budget, leaf, wave
        self.labels = np.arange(len(values))
        self.walked = self.pruned = 0
        self.ones: dict[int, np.ndarray] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _ones(self, bit: int) -> np.ndarray:
        """How many of the values before each place have the bit set."""
        if bit not in self.ones:
            set_here = ((self.values >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
            self.ones[bit] = np.concatenate([[0], np.cumsum(set_here)]).astype(np.int32)
        return self.ones[bit]

    def _merge(self) -> None:
        if self.held:
            self.labels = merged(self.labels, *(np.concatenate([x[k] for x in self.held]) for k in (0, 1)))
            self.held, self.waiting = [], 0

    def _open(self, pairs: np.ndarray) -> np.ndarray:
        """Without the pairs whose values are all of one class."""
        self._merge()
        breaks = np.concatenate([[0], np.cumsum(self.labels[1:] != self.labels[:-1])])
        a0, a1, b0, b1, _ = pairs
        done = (breaks[a1 - 1] == breaks[a0]) & (breaks[b1 - 1] == breaks[b0]) & (self.labels[a0] == self.labels[b0])
        return pairs[:, ~done]

    def _compare(self, pairs: np.ndarray) -> None:
        a0, a1, b0, b1, _ = pairs
        n = (a1 - a0) * (b1 - b0)
        for at in range(0, len(n), 1 << 15):
            some = slice(at, at + (1 << 15))
            each = np.repeat(np.arange(len(n[some])), n[some])
            nth, width = np.arange(len(each)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]), (b1 - b0)[some][each]
            u, v = a0[some][each] + nth // width, b0[some][each] + nth % width
            near = (u < v) & (np.bitwise_count(self.values[u] ^ self.values[v]) <= self.budget)
            self.held.append((u[near], v[near]))
            self.waiting += int(near.sum())
            if self.waiting > 1 << 20:
                self._merge()

    def join(self, pairs: np.ndarray, bits: int) -> np.ndarray:
        """Labels after walking from ``pairs``, rows (start, end, start, end, bits used) with ``bits`` bits below their nodes."""
        stack = [(bits, pairs)]
        while stack:
            bits, pairs = stack.pop()
            if pairs.shape[1] > self.wave:
                stack += [(bits, pairs[:, : pairs.shape[1] // 2]), (bits, pairs[:, pairs.shape[1] // 2 :])]
                continue
            a0, a1, b0, b1, used = pairs
            small = ((a1 - a0) * (b1 - b0) <= self.leaf) | (bits == 0)
            self._compare(pairs[:, small & ((a0 != b0) | (a1 - a0 > 1))])
            pairs = pairs[:, ~small]
            if not pairs.shape[1]:
                continue
            pairs = self._open(pairs)
            a0, a1, b0, b1, used = pairs
            ones = self._ones(bits - 1)
            am, bm, apart = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0]), a0 != b0
            self.walked += len(a0)
            self.pruned += int((used == self.budget).sum())
            down = [(a0, am, b0, bm, used), (am, a1, bm, b1, used)]
            down += [tuple(x[used < self.budget] for x in (a0, am, bm, b1, used + 1)), tuple(x[apart & (used < self.budget)] for x in (am, a1, b0, bm, used + 1))]
            pairs = np.concatenate([np.stack(x) for x in down], axis=1)
            pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2])]
            if pairs.shape[1]:
                stack.append((bits - 1, pairs))
        self._merge()
        return self.labels


GROUP = ["part", "depth", "a", "b"]  # a pair of trie nodes: which rotation, bits on their paths, the two paths


def _links_of(nodes, budget: int, held_values: int = 1 << 16):
    """Arrow batches sorted by (GROUP, side, value) to links (a, b): a spanning forest of the classes of each node pair."""
    import pyarrow as pa

    edges = part_edges(budget)

    def emit(parts):
        t = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        u, v = [], []
        for depth in np.unique(t["depth"]):
            own = {k: x[t["depth"] == depth] for k, x in t.items()}
            new = np.ones(len(own["value"]) + 1, bool)  # where a group or its other side begins
            new[1:-1] = np.logical_or.reduce([own[k][1:] != own[k][:-1] for k in (*GROUP, "side")])
            edge = np.flatnonzero(new)
            start, end = edge[:-1], edge[1:]
            alone = own["a"][start] == own["b"][start]
            left = np.flatnonzero(~alone & (own["side"][start] == 0))
            left = left[left + 1 < len(start)]
            left = left[np.logical_and.reduce([own[k][start[left]] == own[k][start[left + 1]] for k in GROUP])]  # the other side may be empty
            used = np.bitwise_count(own["a"][start[left]] ^ own["b"][start[left]]).astype(np.int64)
            pairs = np.concatenate([np.stack([start[alone], end[alone], start[alone], end[alone], np.zeros(alone.sum(), np.int64)]), np.stack([start[left], end[left], start[left + 1], end[left + 1], used])], axis=1)
            values = own["value"].view(np.uint64)
            labels = TrieJoin(values, budget).join(pairs, BITS - int(depth))
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            back = np.array([BITS - e for e in edges[:-1]], np.uint64)[own["part"][linked]] & np.uint64(BITS - 1)  # turns a value back
            turn = lambda x, back=back: (x << back) | (x >> ((np.uint64(BITS) - back) & np.uint64(BITS - 1)))
            u.append(turn(values[linked]))
            v.append(turn(values[labels[linked]]))
        a, b = (np.concatenate(x).view(np.int64) for x in (u, v))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[dict[str, np.ndarray]] = []
    n = 0
    for batch in nodes:
        t = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*GROUP, "side", "value")}
        if not len(t["value"]):
            continue
        held.append(t)
        n += len(t["value"])
        if n < held_values:
            continue
        t = {k: np.concatenate([h[k] for h in held]) for k in t}
        cut = int(np.argmax(np.logical_and.reduce([t[k] == t[k][-1] for k in GROUP])))  # the last group may go on
        if cut:
            yield from emit([{k: x[:cut] for k, x in t.items()}])
        held = [{k: x[cut:] for k, x in t.items()}]
        n = n - cut if cut else n
    if held:
        yield from emit(held)


def link_values(values: DataFrame, budget: int = 4, most: int = 50_000, step: int = 4) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of ``values.fp`` (distinct longs) within ``budget`` bits.

    Every value is a leaf of ``budget`` + 1 tries, one per rotation that brings another part of the bits to the
    front: values within the budget agree in one part, so in that trie they lie under one node at its depth.
    These nodes, paired with themselves, are dealt to tasks, and ``TrieJoin`` walks the node pairs below them. A
    pair of nodes with over ``most`` leaves is taken ``step`` bits further down before it is dealt, into the pairs
    of its children that the budget allows, again and again until no pair is larger. Each node pair gives a
    spanning forest of its classes, not all pairs.
    """
    edges = part_edges(budget)
    fp = F.col("fp")

    def trie(k: int):
        at, width = edges[k], edges[k + 1] - edges[k]
        turned = F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, BITS - at)) if at else fp
        path = F.shiftrightunsigned(turned, BITS - width)
        return F.struct(F.lit(k).alias("part"), F.lit(width).alias("depth"), path.alias("a"), path.alias("b"), F.lit(0).alias("side"), turned.alias("value"))

    nodes = values.select(F.explode(F.array(*[trie(k) for k in range(budget + 1)])).alias("n")).select("n.*")
    settled = []
    while True:
        large = nodes.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > most).where(F.col("depth") <= BITS - step).drop("n")
        large = park(large, "large-nodes")
        if large.isEmpty():
            break
        nodes = park(nodes, "nodes")
        settled.append(nodes.join(large, GROUP, "left_anti"))
        own = F.shiftrightunsigned("value", F.lit(BITS - step) - F.col("depth")).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        below = nodes.join(large, GROUP, "left_semi").withColumn("own", own)
        other = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
        mine = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))
        path = lambda node, child: F.shiftleft(node, step).bitwiseOR(child)
        partners = F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << step) - 1).cast("long")), lambda x: F.struct(path(mine, F.col("own")).alias("mine"), path(other, x).alias("other")))
        partners = F.filter(partners, lambda x: F.bit_count(x["mine"].bitwiseXOR(x["other"])) <= budget)
        below = below.withColumn("to", F.explode(partners))
        twin = F.col("a") == F.col("b")  # the children of one node: their pairs have the lesser path first
        side = F.when(twin, (F.col("to.mine") > F.col("to.other")).cast("int")).otherwise(F.col("side"))
        below = below.withColumn("_side", side)
        first, second = F.when(F.col("_side") == 0, F.col("to.mine")).otherwise(F.col("to.other")), F.when(F.col("_side") == 0, F.col("to.other")).otherwise(F.col("to.mine"))
        nodes = below.select("part", (F.col("depth") + step).alias("depth"), first.alias("a"), second.alias("b"), F.col("_side").alias("side"), "value")
    for part in settled:
        nodes = nodes.union(part)
    dealt = nodes.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "value")
    return dealt.mapInArrow(lambda batches: _links_of(batches, budget), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the least node of its class: alternating large and small stars.

    The least neighbour of each node is written before it meets the edges, so both sides of that join are plain
    shuffles, which adaptive execution can split where one node has very many edges. A round's tables are
    removed once the next round is written.
    """
    spark = links.sparkSession
    old: list[str] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        path = new_folder(spark, tag)
        old.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def met(edges: DataFrame, low: DataFrame) -> DataFrame:
        return edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        done = list(old)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = kept(met(both.where("v > u"), least).where("u <> v").distinct(), "large")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        edges = kept(met(large, low).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for path in done:
            remove_folder(spark, path)
        del old[: len(done)]
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def group_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, budget: int | None = None) -> DataFrame:
    """``docs`` with long ``_fp``, ``_component`` (the smallest doc_id reachable over links) and boolean ``_kept``.

    Links join texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more
    (exact, ``similar_classes``); ``_fp`` is a key of the set. With ``budget``, ``_fp`` is the fingerprint over
    ``width``-word shingles, links join fingerprints within that many bits, and ``similarity`` is not used.

    Equal ``_fp`` collapse (map-side combined) before the join, so copies cost one value however many
    there are. Every document's whole text is hashed in Arrow batches. Exactly one row of each class has
    ``_kept``: one with the smallest id.

    Nulls: null and empty texts, or texts of blanks, have ``_fp`` zero; they link like any other fingerprint,
    and as sets to one another only. A null id counts for no minimum; a class without ids has a null component.
    Repeated rows share their class. An empty table gives no rows. Columns ``_fp``, ``_component``, ``_kept``,
    ``_first`` and ``_sh_row`` of the input, in any case, are replaced.
    """
    if budget is None:
        # texts meet in Python here; all of it runs before this returns
        with arrow_batches(docs.sparkSession, 8 << 20):
            return _grouped(docs, width, similarity, budget)
    return _grouped(docs, width, similarity, budget)


def _grouped(docs: DataFrame, width: int, similarity: float, budget: int | None) -> DataFrame:
    own = other_columns(docs, "_fp", "_component", "_kept", "_first", "_sh_row")
    if budget is None:
        marks = docs.select(*own, marks_udf(docs, width, similarity)(F.col("text")).alias("_first"), F.monotonically_increasing_id().alias("_sh_row"))
        hashed = marks.select(*own, F.col("_first.key").alias("_fp"), "_first", "_sh_row")
    else:
        hashed = docs.select(*own, fingerprint_udf(width)(F.col("text")).alias("_fp"), F.monotonically_increasing_id().alias("_sh_row"))
    if budget is not None and set(own) <= {"doc_id", "text"}:
        hashed = hashed.drop("text")
    marked = park(hashed, "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_sh_row").alias("row")))
    values = park(marked.groupBy(F.col("_fp").alias("fp")).agg(first.alias("least")), "values")
    if budget is None:
        roots = similar_classes(marked.select("_first.*", "text"), width, similarity, components)
        marked = marked.drop("_first")
    else:
        roots = components(link_values(values.select("fp"), budget))
    classes = values.join(roots, values.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("least"))
    lookup = park(classes.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("_fp"), F.col("least.id").alias("_component"), F.col("least.row").alias("_first")), "classes")
    kept = [c for c in marked.columns if c != "_sh_row"]
    return marked.join(lookup, "_fp", "left").select(*kept, "_component", (F.col("_sh_row") == F.col("_first")).alias("_kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group_near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, budget=4)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
