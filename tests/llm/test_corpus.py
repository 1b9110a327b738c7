"""The corpus operators against brute force, round trips and SQL, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF, same_rows
from strandline.llm import blocks, decontaminate, digests, language, language_model, mixing, repeats, sharding, simhash, similar, toxicity, warc
from strandline.llm.common import new_folder, park, table

LONG = " ".join(f"wort{i * 37 % 101}" for i in range(4000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards boil green soup near midnight"
KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that operators must bear: nulls in any column, empty and long texts, repeated rows, clashing names."""
    texts = [(1, "Ab ab AB"), (2, None), (3, ""), (None, "no id here, you idiot."), (4, LONG), (5, LONG + " end"), (6, PASSAGE), (6, PASSAGE), (7, "x " + PASSAGE + " y"), (8, "   \t\n"), (9, "ÄÖ ß 漢字"), (None, None), (10, "aaaa" * 60), (11, "aaaa" * 60)]
    rows = [(i, t, "en" if n % 3 else None, "s1" if n % 2 else None, None, 7, "clash") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def low(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- archives


def test_warc_sql(spark, duck):
    same_rows(warc.op1_warc(spark, SF).toPandas(), duck(warc.OP1_SQL))


def test_warc_odd_pages(spark):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "ß" * 100_000), (6, "u", "one"), (7, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    out = warc.read_archives(park(warc.write_archives(pages, new_folder(spark, "t")), "p"), range_bytes=200)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert (got[2].record_type, got[1].record_type, got[1].refers_to, got[None].refers_to) == ("response", "revisit", 2, 2)
    assert (got[4].record_type, got[3].refers_to, got[3].payload_bytes) == ("response", 4, 0)
    assert got[5].payload_bytes == 200_000 and bytes(got[5].payload).decode() == "ß" * 100_000
    empty = warc.write_archives(pages.limit(0), new_folder(spark, "t"))
    assert warc.read_archives(park(empty, "p")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    out = io.BytesIO()
    package = warc.StoredZip(out, zip64)
    for name, data in (("a", b"one"), ("b/c", b"two" * 1000)):
        package.begin(name)
        package.write(data)
        package.end()
    package.close()
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("b/c") == b"two" * 1000
    found = warc.members(out)
    at, n = found["b/c"]
    assert out.getvalue()[at : at + n] == b"two" * 1000 and set(found) == {"a", "b/c"}


# --- mixing and sharding


def test_mixing_sql(spark, duck):
    same_rows(mixing.op2_mixing(spark, SF).toPandas(), duck(mixing.OP2_SQL))


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd, buckets=4).toPandas()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0 and (got.target == "clash").all()
    m = mixing.mix(odd, buckets=4).select("source", "_mix.*").toPandas()
    assert (m.taken <= 2 * m["size"]).all()
    for _, g in m.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= len(g)


def test_water_level(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources, (5, 2, 1), 1.5, 2).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx(2995 * 2 / 3) and got["c"] == pytest.approx(2995 / 3) and got[None] == 0


def test_sharding(spark, docs, odd, none):
    out = sharding.op3_sharding(spark, SF).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((out.shard == out.grown_shard) | (out.grown_shard == 40)).all() and out.shard.between(0, 39).all()
    again = sharding.op3_sharding(spark, SF).toPandas()
    same_rows(out, again)
    small = sharding.shuffle_into_shards(odd, 3, bucket_bytes=2000).toPandas()
    assert len(small) == odd.count() and sharding.shuffle_into_shards(none).count() == 0
    for _, g in small.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())
    assert list(sharding.fisher_yates(1, np.random.default_rng(0))) == [0] and len(sharding.fisher_yates(0, np.random.default_rng(0))) == 0


# --- language and toxicity


def test_all_segmentations_are_summed():
    pieces = ["a", "ab", "b", "ba", "bab"]
    probs = np.vstack([np.random.default_rng(1).random((5, 2)), [[1e-9, 1e-9]]])
    s = language.Segmenter(pieces, probs)

    def brute(w):
        if not w:
            return np.ones(2)
        return sum((probs[pieces.index(w[:m])] if w[:m] in pieces else probs[5] * (m == 1)) * brute(w[m:]) for m in range(1, min(3, len(w)) + 1))

    sample = ["ab", "babab", "xab", "b", "a" * 70, "abba"]
    got = s.forward(sample)
    assert np.allclose(got[[0, 1, 2, 3, 5]], np.log([brute(sample[i]) for i in (0, 1, 2, 3, 5)]))
    assert np.allclose(got[4], s._in_logs("a" * 70))


def test_language(spark, docs, odd, none):
    got = language.op4_language(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    model = language.learn(docs.select("text", "lang"), sample=50, rounds=1)
    found = {r.doc_id: r._lang for r in language.predict_language(odd, *model, most_words=3).collect()}
    assert found[2].pred == "und" and found[3].pred == "und" and found[8].pred == "und" and found[4].pred in model[0]
    assert language.predict_language(none, *model).count() == 0
    nothing = language.learn(none.select("text", "lang"))
    assert {r._lang.pred for r in language.predict_language(odd, *nothing).collect()} == {"und"}


def test_clauses():
    m, classes = toxicity.Composed(), toxicity.Classes(["zork"], ["blarg"])
    out = lambda text: dict(zip(toxicity.OUTPUTS, m.outputs(text.split(), classes), strict=True))
    assert out("what an idiot")["insult"] == 1
    assert out("you are an idiot")["insult at a target"] == 1
    assert out("he is not an idiot")["negated insult"] == 1
    assert out("they said someone is an idiot")["reported insult"] == 1
    assert out("i will kill you")["threat at a target"] == 1
    assert out("zork and blarging")["insult"] == 2


def test_toxicity(spark, docs, odd, none):
    labels = table(spark, SF, "labels")
    got = toxicity.op5_toxicity(spark, SF).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    truth = got.merge(labels.toPandas())
    assert truth[truth.toxic == 0].predicted.mean() < 0.05 and truth[truth.toxic == 1].predicted.mean() > 0.4
    some = {r.doc_id: r._toxic for r in toxicity.toxicity(odd, labels.limit(0)).collect()}
    assert some[None].score > some[1].score or some[1].predicted == 0
    assert toxicity.toxicity(none, labels).count() == 0


# --- near duplicates and repeats


def brute_fingerprint(text):
    w = [low(x) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_words(spark, texts, odd):
    for t in [*list(texts.values())[:30], None, "", "one", "A b C d", LONG]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    first = odd.where("doc_id = 6").select(F.xxhash64("text").alias("h")).first().h
    assert first & (2**64 - 1) == xxhash.xxh64_intdigest(PASSAGE.encode(), 42)


def brute_classes(values, budget=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("most", [20_000, 30])
def test_trie_join(spark, most):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = {0, 2**64 - 1, *(int(c) for c in centres)}
    for c in centres.tolist():
        for _ in range(30):
            v = c
            for b in rng.integers(0, 64, rng.integers(1, 8)).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.link_values(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    groups = defaultdict(set)
    for v, s in zip(values, signed, strict=True):
        groups[roots.get(s, s)].add(v)
    assert {frozenset(g) for g in groups.values()} == brute_classes(values)
    n = len(values)
    for leaf, wave in ((1, 50), (32, 1 << 16)):
        walk = simhash.TrieJoin(np.array(values, np.uint64), 4, leaf, wave)
        labels = walk.join(np.array([[0], [n], [0], [n], [0]]), 64)
        local = defaultdict(set)
        for v, x in zip(values, labels, strict=True):
            local[x].add(v)
        assert {frozenset(g) for g in local.values()} == brute_classes(values)
        assert walk.walked > 100 and walk.pruned > 10


def test_documents_meet_in_tries(texts, monkeypatch):
    """Nodes that hold several fingerprints of the fixture are walked in pairs, and the budget prunes."""
    prints = np.array(sorted({simhash.fingerprint(t) for t in texts.values()}), np.uint64)
    walk = simhash.TrieJoin(prints, 4)
    labels = walk.join(np.array([[0], [len(prints)], [0], [len(prints)], [0]]), 64)
    groups = defaultdict(set)
    for v, x in zip(prints.tolist(), labels, strict=True):
        groups[x].add(v)
    assert {frozenset(g) for g in groups.values()} == brute_classes(prints.tolist())
    assert walk.walked > len(prints) and walk.pruned > 0


def test_values_of_one_class_are_not_compared_again():
    """A dense group costs no comparison of all pairs once its values are of one class."""
    dense = np.array(sorted({(1 << 40) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    walk = simhash.TrieJoin(dense, 4, leaf=16, wave=256)
    assert set(walk.join(np.array([[0], [len(dense)], [0], [len(dense)], [0]]), 64).tolist()) == {0}
    assert walk.walked < len(dense) ** 2 / 8


def test_near_duplicates(spark, texts, odd, none):
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, SF).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = {v: g for g in brute_classes(sorted(set(prints.values()))) for v in g}
    least = {v: min(i for i, p in prints.items() if p in g) for v, g in groups.items()}
    assert all(int(got[i].fingerprint, 16) == p and got[i].component_id == least[p] for i, p in prints.items())
    out = simhash.group_near_duplicates(odd).collect()
    assert len(out) == odd.count() and sum(r._kept for r in out) == len({(r._component, r._component is None and r._fp) for r in out})
    assert {r._component for r in out if r.doc_id in (2, 3, 8)} == {2}
    assert simhash.group_near_duplicates(none).count() == 0


@pytest.mark.parametrize("many,block", [(256, 1 << 23), (2, 60_000)])
def test_repeats(spark, docs, odd, none, texts, monkeypatch, many, block):
    monkeypatch.setattr(repeats, "MANY", many)

    def brute(rows):
        first = {}
        for i, t in rows:
            b = (t or "").encode()
            for p in range(len(b) - 49 if i is not None else 0):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
        out = []
        for i, t in rows:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 49 if i is not None else 0):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return sorted(out)

    for frame in (docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = repeats.remove_repeats(frame, block).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    assert repeats.remove_repeats(none).count() == 0


# --- scoring


def test_tokens_are_words(texts):
    sample = [*list(texts.values())[:40], None, "", "  ", LONG, "\x0bA\x0cb a"]
    hashes, sizes = blocks.tokens(sample)
    assert sizes.tolist() == [len(words(t)) + 1 for t in sample]
    names = [w for t in sample for w in [*(low(x) for x in words(t)), None]]
    assert len({(n, h) for n, h in zip(names, hashes.tolist(), strict=True)}) == len(set(names)) == len(set(hashes.tolist()))
    assert (blocks.unpacked(blocks.packed(np.sort(hashes), True), True) == np.sort(hashes)).all()


def test_language_model(spark, texts, odd, none):
    got = language_model.op8_language_model(spark, SF).toPandas()
    toks = {i: [low(w) for w in words(t)] + [None] for i, t in texts.items()}
    count = Counter(w for i, v in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in v)
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        own = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score <= 0).all()
    out = language_model.score_documents(odd, F.col("doc_id").isNotNull())
    assert out.count() == odd.count()
    unlearned = language_model.score_documents(odd, F.lit(False)).toPandas()
    assert np.isfinite(unlearned.score).all() and (unlearned.train_tokens == 0).all()
    assert language_model.score_documents(none, F.lit(True)).count() == 0


def test_mixture_weights_maximise():
    cells = [(1, -8, -32, 50), (1, 1, -32, 50), (2, -1, -40, 100)]
    w = language_model.learn_weights(cells, 1e-6)
    assert np.allclose(w.sum(axis=1), 1) and w[2, 0] > 0.9 > w[1, 0] > 0.3


# --- decontamination and fingerprints


def test_decontamination_sql(spark, duck):
    same_rows(decontaminate.op9_decontaminate(spark, SF).toPandas(), duck(decontaminate.OP9_SQL))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination_odd_rows(spark, odd, none, rows):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "ab ab"), (3, None), (None, PASSAGE), (4, "  "), (5, "fox JUMPS over"), (6, "ab ab ab ab")], "item_id long, text string")
    got = {r.doc_id: r._hit for r in decontaminate.contamination(odd, bench, broadcast_rows=rows).where("doc_id is not null").collect()}
    n = len(PASSAGE.split())
    assert (got[6].n_hit, got[6].items) == (n, ["1", "5"]) and (got[7].n_hit, got[7].n_words) == (n, n + 2)
    assert (got[1].n_hit, got[1].items) == (3, ["2"]) and not got[4].contaminated and got[2].n_words == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("_hit.contaminated").count() == 0


def test_rarity_is_entropy():
    x = np.frombuffer((PASSAGE * 3 + "zz" * 50).encode(), np.uint8)
    def entropy(w):
        p = np.bincount(w)[np.bincount(w) > 0] / len(w)
        return round(float(-(p * np.log2(p)).sum()) * 64)
    assert np.abs(digests.rarity(x) - [entropy(x[i : i + 64]) for i in range(len(x) - 63)]).max() <= 1


def test_features_are_local():
    data = (PASSAGE * 5 + LONG).encode()
    whole = digests.features(data)
    assert (digests.features(data, 700) == whole[whole >= 700]).all() and len(whole) > 100


def test_digests(spark, texts, odd, none):
    got = digests.op10_fingerprints(spark, SF).toPandas().set_index("doc_id")
    ids = sorted(texts)
    for at, i in enumerate(ids):
        t, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint[i] == digests.digest(t) and got.edited_fingerprint[i] == digests.digest(edited)
    long = got[got.n_chars > 2000]
    assert long.near_edited.median() > 0.4 and long.near_next.median() < 0.1 and got.near_edited.between(0, 1).all()
    small = digests.fingerprints(odd).collect()
    assert len(small) == odd.count() and digests.fingerprints(none).count() == 0
    one = digests.fingerprints(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_ranges_follow_on(spark, texts):
    small = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = digests.followed(small, rows_per_range=15).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.range].append((r.extra, tuple(r.place), r.doc_id))
    order = [sorted(by[k]) for k in sorted(by)]
    assert [d for g in order for e, _, d in g if not e] == sorted(texts)
    assert all([d for e, _, d in g if e] == [order[(k + 1) % len(order)][0][2]] for k, g in enumerate(order))


def shingles5(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_similar_texts_by_brute_force(spark):
    """Copies with a few edits: classes of the default are those of all pairs with a Jaccard similarity of 0.8 or more over five words."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows = [" ".join(["shared line of seven words in all", *rng.choice(vocabulary, 40)]) for _ in range(60)]
    for n, edits in ((60, 1), (60, 2), (200, 4), (200, 6), (400, 10), (400, 14)):
        for _ in range(4):
            base = rng.choice(vocabulary, n)
            rows.append(" ".join(base))
            for _ in range(6):
                w = base.copy()
                w[rng.choice(n, edits, replace=False)] = rng.choice(vocabulary, edits)
                rows.append(" ".join(w))
    passage = rng.choice(vocabulary, 100)
    rows += [" ".join([*rng.choice(vocabulary, own // 2), *passage, *rng.choice(vocabulary, own - own // 2)]) for own in (4, 8, 12, 16, 20, 24, 30, 40) for _ in range(8)]
    rows += ["", "  ", "one two", "One  two", "a b c d e", "a b c d e f"]
    sets = [shingles5(t) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                i1, j1 = find(i), find(j)
                root[max(i1, j1)] = min(i1, j1)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r._component for r in simhash.group_near_duplicates(frame).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) < len(rows) - 50  # near copies have met


def test_common_hashes_by_brute_force(spark):
    """Counts are those of all sets, however texts are dealt; a bound keeps the most frequent."""
    rng = np.random.default_rng(5)
    rows = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(300)] + ["", "one"]
    frame = spark.createDataFrame([(t,) for t in [*rows, None]], "text string").repartition(7)
    held = Counter(int(h) for t in set(rows) for h in similar.shingle_set(t, 5))
    few = {k: n for k, n in held.items() if n > 1}
    hashes, counts, shift = similar.common_hashes(frame, 5, range_bytes=256, held_hashes=1)
    sums = Counter(int(h) for t in rows for h in similar.shingle_set(t, 5))
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == {h >> shift: n for h, n in sums.items() if n > 1} and shift < 24
    assert {h >> shift for h in few} <= set(hashes.tolist()) and (np.diff(hashes.astype(object)) > 0).all()
    most, n, _ = similar.common_hashes(frame, 5, bound=50, range_bytes=256)
    assert 0 < len(most) <= 50 and n.min() >= np.sort(counts)[-60]
    assert len(similar.common_hashes(frame.where("text = 'one'").limit(1), 5)[0]) == 0
    assert len(similar.common_hashes(frame.where("text is null"), 5)[0]) == 0


def test_all_letter_pieces_are_learned(none):
    """Also pieces of over five characters, the start mark included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language.VOCABULARY)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    letters = {p for p in (model.id_to_piece(i).lower() for i in usable) if p == "\u2581" or re.fullmatch(r"\u2581?[^\W\d_]+", p)}
    assert max(map(len, letters)) > 5
    assert set(language.learn(none.select("text", "lang"))[1]) == letters
