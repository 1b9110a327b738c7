"""Resampling, clusters and packing against brute force and SQL, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF, same_rows
from strandline.llm import clustering, packing, resampling

LONG = " ".join(f"wort{i * 37 % 101}" for i in range(9000))
KIND = "doc_id long, text string, _Drawn string, START long, ids int, _pk_text int"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "Ab ab AB " * 10), (2, None), (3, ""), (None, "no id here " * 9), (4, LONG), (5, LONG + " end"), (6, "ß 漢字 é" * 30), (6, "ß 漢字 é" * 30), (None, None), (8, " \t\n")]
    texts += [(i, f"some words of text number {i % 4} " * 5) for i in range(10, 40)]
    return spark.createDataFrame([(*t, "clash", 1, 2, 3) for t in texts], KIND)


# --- resampling


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcz09éß漢", min_size=1, max_size=40), min_size=1, max_size=12), st.integers(1, 5))
def test_crc_of_runs(words, longest):
    data = [w.encode() for w in words]
    crc = np.array([zlib.crc32(w) for w in data], np.uint32)
    found = [x for run in resampling.ngram_crcs(crc, np.array([len(w) for w in data]), longest) for x in run.tolist()]
    assert found == [zlib.crc32(b" ".join(data[i : i + n])) for n in range(1, longest + 1) for i in range(len(data) - n + 1)]


def test_features_across_pieces(monkeypatch):
    text = ("Ab c-d " * 50 + "é漢 x").encode()
    pieces = resampling._words
    whole = [resampling.features(text, n) for n in (1, 2, 4)]
    whole = [sorted(x for _, crc in f for x in crc.tolist()) for f in whole]
    monkeypatch.setattr(resampling, "_words", lambda data: pieces(data, 16))
    assert [sorted(x for _, crc in resampling.features(text, n) for x in crc.tolist()) for n in (1, 2, 4)] == whole
    assert sum(n for n, _ in resampling.features(text, 3)) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.decode().lower()))


def brute_draw(docs, target, percent, longest, buckets, least):
    """docs: (doc_id, text). Rows (doc_id, n_features, weight, score, rank), n-grams as strings."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in docs for b in grams(split(x))), Counter(b for x in target for b in grams(split(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, x in docs:
        g = grams(split(x))
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(split(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted(map(repr, (r[:5] for r in rows)))


@pytest.mark.parametrize("how", [{}, {"longest": 3, "percent": 60, "buckets": 97, "least_words": 1}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_draw(spark, odd, how):
    target = spark.createDataFrame([("number 3 of WORDS",), (None,), ("",), ("ab ab words",)], "text string")
    found = resampling.resample(odd, target, **how)
    assert sorted(c.lower() for c in found.columns) == sorted(c.lower() for c in odd.columns)
    rows = [list(r) for r in found.select("doc_id", "_drawn.n_features", "_drawn.weight", "_drawn.score", "_drawn.rank").collect()]
    own = {"percent": 10, "longest": 1, "buckets": 10_000, "least_words": 20} | how
    want = brute_draw([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], own["percent"], own["longest"], own["buckets"], own["least_words"])
    assert sorted(map(repr, rows)) == want


def test_draw_of_empty_tables(spark, odd):
    none = odd.where("false")
    assert resampling.resample(none, odd).count() == 0
    assert resampling.resample(odd, none).where("_drawn.rank is not null").count() == 3
    alike = spark.createDataFrame([(7, "word " * 20)] * 50, "doc_id long, text string")
    assert sorted(r.rank for r in resampling.resample(alike, none, percent=40).select("_drawn.rank").collect() if r.rank) == list(range(1, 21))


def test_resampling_sql(spark, duck):
    same_rows(resampling.op11_resampling(spark, SF).toPandas(), duck(resampling.OP11_SQL))


# --- clusters


def brute_clusters(rows, k, rounds, size, scale):
    """rows: (vec_id, components). vec_id -> (cluster, distance, cluster_inertia, inertia, centroid), in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(cents)]
    best = [near(v) for _, v in kept]
    each = Counter()
    for d, n in best:
        each[n] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted(repr((i, n, fits(d), fits(each[n]), fits(each.total()), [str(x) for x in cents[n]])) for (i, _), (d, n) in zip(kept, best, strict=True))


@pytest.mark.parametrize("spread", [1.0, 3e4, 2e6, 1e12, 1e30])
def test_clusters(spark, spread):
    """From products of doubles to integers beyond 64 bits."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 0.7) * (spread if rng.random() < 0.9 else 1) for _ in range(6)]) for i in range(160)]
    rows += [(500, [1.0] * 6), (500, [1.0] * 6), (501, [0.0] * 6), (502, None), (503, [1.0] * 5), (504, [1.0] * 5 + [None]), (505, [1.0] * 5 + [float("nan")]), (506, [float("-inf")] * 6), (None, [2.0] * 6), (507, [])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, _CLUSTER string, cluster int")
    for k, rounds in ((4, 3), (1, 1), (500, 2)):
        found = clustering.cluster(vectors, k=k, rounds=rounds, size=6)
        assert found.columns[:3] == ["vec_id", "embedding", "cluster"]
        got = sorted(repr((r.vec_id, *r._cluster)) for r in found.collect())
        assert got == brute_clusters(rows, k, rounds, 6, 1024)


def test_cluster_blocks(monkeypatch):
    """Ties go to the smaller number, over the bounds of blocks of centroids as well."""
    monkeypatch.setattr(clustering, "CENTRES", 3)
    x = np.array([[0.0, 0.0], [9.0, 9.0], [4.0, 5.0]])
    centres = clustering.Centres([[5, 5], [0, 1], [1, 0], [9, 9], [-1, 0], [9, 9], [0, -1]])
    best, distance = centres.nearest(x)
    assert best.tolist() == [1, 3, 0] and distance == [1, 0, 1]
    sums = clustering.Sums(7, 2).add(x, best, distance)
    assert sums.counts == [1, 1, 0, 1, 0, 0, 0] and sums.sums.tolist()[3] == [9, 9]
    for _ in range(3):
        sums = clustering.Sums(1, 2).add(np.full((2, 2), -float(1 << 61)), np.zeros(2, int), [1 << 80, 1]).merge(clustering.Sums(1, 2))
    assert sums.sums.tolist() == [[-(1 << 62)] * 2] and sums.inertia == [(1 << 80) + 1]


def test_clusters_of_empty_table(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clusters_sql(spark, duck):
    same_rows(clustering.op12_clusters(spark, SF).toPandas(), duck(clustering.OP12_SQL))


# --- packing


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), most=20)


ODD_CHARS = st.text(alphabet=st.one_of(st.sampled_from("abzAZ09'.,-  \t\n\x0b\x1c\x1f\x7f\x85\xa0éÉßẞİıſŉΣςσ´̈²½ª«»“”—…º°·漢字ﬁ😀 ​"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD_CHARS)
def test_ids_are_the_tokenizers(whole, encoder, text):
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_every_simple_character(whole, encoder):
    simple = [c for c in map(chr, range(0x2100)) if not packing.ODD.search(c)]
    texts = [t for c in simple for t in (c, f"a{c}b", f"{c}{c}1{c}'s", f"É{c}é.")] + ["x<|endoftext|>y", "it's 'TWAS we'LL", "<|startoftext|>"]
    for text, found in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == found.ids, text
    long = " ".join(texts)
    assert encoder.encode(long.encode(), most=50) == np.array(whole.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, texts, whole, capacity):
    """rows: pieces as dicts; texts: all texts with their ids. Each id in one piece, sequences gapless, full or a power of two long."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    for doc, text in texts:
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        got = {}
        for r in by_doc[doc]:
            assert r["doc_tokens"] == len(want)
            got[r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(got[r["start"]]) == r["length"]
        assert [x for _, ids in sorted(got.items()) for x in ids] == want
    return by_seq


@pytest.mark.parametrize("capacity, block", [(2048, 1 << 20), (16, 100), (64, 1)])
def test_packing(spark, odd, whole, capacity, block):
    some = odd.where("doc_id is not null and doc_id <> 6").repartition(2)
    found = packing.pack(some, capacity=capacity, block_tokens=block)
    assert found.columns == ["doc_id", "_Drawn", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = [r.asDict() for r in found.collect()]
    by_seq = check_packing(rows, [(r.doc_id, r.text) for r in some.collect()], whole, capacity)
    if block == 1 << 20:
        joined = {r.sequence_id: r for r in packing.sequences(found).collect()}
        assert {s: sum(n for _, n in p) for s, p in by_seq.items()} == {s: r.n_ids for s, r in joined.items()}
        assert all(len(r.ids) == 4 * r.n_ids for r in joined.values())
    again = packing.pack(odd, capacity=capacity, block_tokens=block)  # null ids and repeated rows
    assert again.agg(F.sum("length")).first()[0] == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack(odd.where("false")).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5.5, 1.0, 3000).astype(np.int64) + 1, 2047)
    pieces = packing.balance(sizes, 2048, 1.0, 1 / 4096)
    cost = defaultdict(float)
    for _, _, n, s in pieces:
        cost[s] += n + n * n / 4096
    full = [c for s, c in cost.items() if s < int(sizes.sum()) // 2048]
    assert len(pieces) - len(sizes) <= len(cost)  # cuts
    apart = [n + n * n / 4096 for n in sizes]  # in the order they come, cut at every 2048 ids
    ends = np.cumsum(sizes) // 2048
    plain = [sum(c for c, e in zip(apart, ends, strict=True) if e == s) for s in range(int(ends[-1]))]
    assert np.std(full) < np.std(plain) / 2


def test_packing_query(spark, whole):
    found = packing.op13_packing(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = found.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
