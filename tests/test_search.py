"""Fuzzy and vector search against all pairs."""

import math
import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from strandline.operators import search, vectors


def grams(text):
    out = []
    for w in (text or "").lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def brute(texts, queries, k, threshold=0.0):
    """{(query, id): (score, rank)} over all pairs."""
    tf = {i: Counter(grams(t)) for i, t in texts}
    df = Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(c):
        w = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    vecs = {i: vector(c) for i, c in tf.items()}
    out = {}
    for q, t in queries:
        v = vector(Counter(grams(t)))
        scores = sorted(((-round(sum(x * o.get(g, 0) for g, x in v.items()), 9), i) for i, o in vecs.items()))
        out |= {(q, i): (-s, r) for r, (s, i) in enumerate([x for x in scores if -x[0] > 0 and -x[0] >= threshold][:k], 1)}
    return out


@pytest.mark.parametrize("k, threshold, seeds", [(3, 0.0, 1), (1, 0.3, 2), (40, 0.0, 3), (5, 0.99, 1)])
def test_search(spark, k, threshold, seeds):
    rng = random.Random(4)
    word = lambda: rng.choice(["lung", "lobe", "upper", "left", "a", "segment", "nodule", "the", "ünder", "漢字", "x9"])
    texts = [(i, " ".join(["the", *(word() for _ in range(rng.randrange(1, 5)))])) for i in range(120)] + [(200, None), (201, "  "), (202, "the"), (203, "the")]
    queries = [(i, f"{word()} {word()}s  LUNGE") for i in range(15)] + [(90, "zzzzz"), (91, None), (92, ""), (93, "THE")]
    index = search.Index(spark.createDataFrame(texts, "id long, text string"))
    found = search.search(index, spark.createDataFrame(queries, "query_id long, text string"), k, threshold, seeds)
    want = brute(texts, queries, k, threshold)
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 1e-8 for p in want)


def test_common_grams_are_left_out(spark, monkeypatch):
    """A gram of nearly all texts isn't looked up when rarer ones decide: its postings may be missing."""
    texts = spark.createDataFrame([(i, f"common rare{i:04d}x") for i in range(300)], "id long, text string")
    index = search.Index(texts)
    asked = spark.createDataFrame([(1, "common rare0123x")], "query_id long, text string")
    whole = search.search(index, asked, k=1).first()
    index.postings = index.postings.where("gram not in (' com', ' comm', 'common', 'ommon', 'mmon ')")
    assert search.search(index, asked, k=1).first() == whole and whole.id == 123 and whole.score == 1.0


def test_grams_are_worked_out_once(spark, monkeypatch):
    """Common words and numbers: the last plan reads tables and makes no grams anew, and few of the texts that share a looked-up gram are scored in full."""
    texts = [(i, f"site{i % 7} example page {i * 7919 % 100_003:05d}") for i in range(4000)]
    queries = [(i, t.replace("s", "z")) for i, t in texts[::80]]
    kept, keep = {}, getattr(search, "written", None)
    monkeypatch.setattr(search, "written", lambda df, tag: kept.setdefault(tag, keep(df, tag)), raising=False)
    found = search.search(search.Index(spark.createDataFrame(texts, "id long, text string")), spark.createDataFrame(queries, "query_id long, text string"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.id): r["rank"] for r in found.collect()} == {p: r for p, (_, r) in brute(texts, queries, 5).items()}
    assert kept["summed"].count() < 60 * len(queries)


def test_matched(spark):
    concepts = [("r1", "Lower lobe", ["basal lobe", None]), ("r2", "lobe", None), ("r3", "liver", []), ("r4", None, ["lowr lobe"])]
    found = search.matched(spark.createDataFrame([(1, "Lower  LOBE"), (2, " "), (3, "lobe")], "query_id int, text string"), spark.createDataFrame(concepts, "concept_id string, label string, synonyms array<string>"), k=3)
    rows = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        rows[r.query_id].append((r.concept_id, r.score))
    assert rows.keys() == {1, 3}
    assert [c for c, _ in rows[1]] == ["r1", "r4", "r2"] and rows[1][0][1] == 1.0
    assert abs(rows[1][1][1] - SequenceMatcher(None, "lower lobe", "lowr lobe").ratio()) < 1e-8
    assert rows[3][0] == ("r2", 1.0) and rows[3][1][0] == "r1"


def test_nearest(spark):
    """Exactly the result of all pairs, whatever the cells; a full cell is split."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=8), (60, 1)), rng.normal(size=(60, 8)) * 1e-3 + 5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [1.0, None] * 4), (None, [1.0, 2.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    one = np.array([1.0, 2.0] * 4) / np.linalg.norm([1.0, 2.0] * 4)
    want = {}
    for q in range(0, len(x), 9):
        scores = sorted([(-round(float(s), 9), i) for i, s in enumerate(u @ u[q])])
        want[q] = [s for s, _ in scores[:7]]
    asked = table.where("vec_id % 9 = 0 or vec_id is null")
    for cells, most in ((12, 20), (1, 10_000), (400, 5)):
        found = vectors.nearest(vectors.VectorIndex(table, 8, cells=cells, most=most), asked, k=7, probes=2, exact=True).collect()
        got = defaultdict(list)
        for r in sorted(found, key=lambda r: r["rank"]):
            got[r.query_id].append(r)
        assert {q for q in got if q is not None} == set(want)
        null = got.pop(None)
        assert null[0].score == 1.0 and len(null) == 7
        for q, scores in want.items():
            clean = [-r.score for r in got[q]]
            best = sorted([*scores, -round(float(one @ u[q]), 9)])[:7]
            assert np.allclose(clean, best, atol=1e-8)
    assert vectors.nearest(vectors.VectorIndex(table.limit(0), 8), asked).count() == 0


def test_recall_of_probes(spark):
    exact = {(r.query_id, r.id) for r in vectors.nearest_vectors(spark, SF).collect()}
    probed = {(r.query_id, r.id) for r in vectors.probed_vectors(spark, SF).collect()}
    assert len(exact & probed) >= 0.95 * len(exact)
