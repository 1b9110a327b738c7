"""Rules worked out a second way, and inputs whose columns, ids or labels clash with what operators use."""

import struct
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF
from strandline.llm import decontaminate, digests, language, language_model, mixing, repeats, sharding, simhash, similar, toxicity
from strandline.llm.common import table


@pytest.fixture(scope="module")
def clash(spark):
    """Columns named like those that operators add or use, in other cases too."""
    names = "SHARD slot Grown_Shard _SH_bucket _sh_row _Toxic _tx_outputs _FP _component _Kept _first n_hit items _HIT _hit_n _c _MIX _mix_plan _LANG word at size f h"
    rows = [(i, f"some words of text number {i % 5} you idiot", "en", "s", *range(len(names.split()))) for i in range(20)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names.split()])


def test_clashing_columns(spark, clash):
    n = clash.count()
    own = lambda df: {c.lower() for c in df.columns}
    bench = spark.createDataFrame([(1, "words of text number 3 you idiot"), (2, None)], "item_id long, text string")
    hit = decontaminate.contamination(clash, bench)
    assert hit.where("_hit.contaminated").count() == 4 and {"n_hit", "items"} <= own(hit)
    shards = sharding.shuffle_into_shards(clash, 3)
    assert shards.count() == n and {"size", "n_hit"} <= own(shards) and len(own(shards)) == len(shards.columns)
    toxic = toxicity.toxicity(clash, spark.createDataFrame([(0, True), (1, False)], "doc_id long, toxic boolean"))
    assert toxic.select("_toxic.score").distinct().count() == 1 and "_tx_outputs" not in own(toxic)
    for how in ({"width": 4, "budget": 4}, {}):
        groups = simhash.group_near_duplicates(clash, **how)
        assert groups.where("_kept").count() == 5 and {r._component for r in groups.collect()} == set(range(5))
    assert mixing.mix(clash).count() == n
    model = language.learn(clash.select("text", "lang"), sample=10, rounds=1)
    assert {r._lang.pred for r in language.predict_language(clash, *model).collect()} == {"en"}
    assert language_model.score_documents(clash, F.lit(True)).count() == n
    assert digests.fingerprints(clash).count() == n


def test_languages_of_any_name(spark):
    names = ["word", "zh.Hans", "a`b", "N", "n"]
    rows = [(f"{w} {w}o {w}i", lang) for lang, w in zip(names, ["abc", "def", "ghi", "jkl", "mno"], strict=True) for _ in range(3)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), rounds=1)
    assert model[0] == sorted(names)
    docs = spark.createDataFrame([(1, "abco abci"), (2, "ghii ghio")], "doc_id long, text string")
    assert [r._lang.pred for r in language.predict_language(docs, *model).orderBy("doc_id").collect()] == ["word", "a`b"]


def test_copies_count_once_in_the_language_sample(spark):
    rows = spark.createDataFrame([("abc abd", "x")] * 50 + [("bcd", "x"), ("bce", "y")], "text string, lang string")
    once = spark.createDataFrame([("abc abd", "x"), ("bcd", "x"), ("bce", "y")], "text string, lang string")
    assert np.allclose(language.learn(rows, rounds=1)[2], language.learn(once, rounds=1)[2])


def test_shards_by_brute_force(spark):
    """Rendezvous hashing worked out with another XXH64."""

    def shard(doc_id, shards):
        def score(s):
            h = 42
            for piece in (struct.pack("<q", doc_id), struct.pack("<i", s), struct.pack("<i", sharding.SEED)):
                h = xxhash.xxh64_intdigest(piece, h)
            return h - (1 << 64) if h >> 63 else h, s

        return max(map(score, range(shards)))[1]

    got = sharding.op3_sharding(spark, SF).collect()
    assert all((r.shard, r.grown_shard) == (shard(r.doc_id, 40), shard(r.doc_id, 41)) for r in got)


def test_clause_outputs_by_brute_force():
    """Distances in words in place of composed machines."""
    words = {toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.OTHER: "tree"}

    def brute(c):
        out = [0] * len(toxicity.OUTPUTS)
        for i, x in enumerate(c):
            before = lambda of, reach, i=i: of in c[max(0, i - reach) : i]
            negated, reported = before(toxicity.NEGATION, 3), toxicity.REPORT in c[:i]
            if x == toxicity.INSULT:
                out[3 if reported else 2 if negated else 1 if before(toxicity.TARGET, 4) else 0] += 1
            elif x == toxicity.THREAT and not (negated or reported):
                out[4] += 1
            elif x == toxicity.TARGET and not (negated or reported):
                out[1] += before(toxicity.INSULT, 3)
                out[5] += before(toxicity.THREAT, 4)
        return out

    rng, machine, classes = np.random.default_rng(2), toxicity.Composed(), toxicity.Classes()
    for _ in range(400):
        c = rng.choice(6, rng.integers(0, 12), p=[0.15, 0.15, 0.15, 0.1, 0.1, 0.35]).tolist()
        c = [[toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER][k] for k in c]
        assert machine.outputs([words[k] for k in c], classes) == brute(c)


def test_toxicity_held_out(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(table(spark, "/root/testdata/sf0.1", "labels").toPandas())
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.05


def test_scores_by_brute_force(spark, monkeypatch):
    """The interpolated score of every text from counts of words and pairs, with given weights by context frequency."""
    weights = np.random.default_rng(4).dirichlet((1, 1, 1), language_model.BUCKETS)
    monkeypatch.setattr(language_model, "learn_weights", lambda cells, unseen: weights)
    rows = [(i, t) for i, t in enumerate(["a b a b c", "A b", "", None, "b b b b b b b b", "never seen words", "a c a b"] * 3)]
    learned = {i for i, _ in rows if i % 4}
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 0).collect()
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    word = Counter(w for i in learned for w in tokens[i])
    pair = Counter(p for i in learned for p in zip(["<s>", *tokens[i]], tokens[i], strict=False))
    n, v = sum(word.values()), len(word)
    context = word | {"<s>": len(learned)}
    for r in got:
        total = 0.0
        for before, w in zip(["<s>", *tokens[r.doc_id]], tokens[r.doc_id], strict=False):
            c = context.get(before, 0)
            a, b, u = weights[0 if c == 0 else min(int(np.log2(c)) + 1, language_model.BUCKETS - 1)]
            total += log10(a * (pair[before, w] / c if c else 0) + b * word[w] / n + u / (v + 1))
        assert r.score == pytest.approx(total)


def test_digests_by_brute_force(spark):
    """Features from the entropy of every window, and likeness from bits set one by one."""
    rng = np.random.default_rng(6)
    base = " ".join("".join(rng.choice(list("abcdefghij "), rng.integers(2, 9))) for _ in range(120))
    text, other = base, base[:350] + base[500:]

    def places(data):
        x = np.frombuffer(data, np.uint8)
        r = []
        for i in range(len(x) - 63):
            p = np.bincount(x[i : i + 64])
            p = p[p > 0] / 64
            r.append(int(np.rint(-(p * np.log2(p)).sum() * 64)))
        return [i for i, v in enumerate(r) if v >= 64 and (v, -i) == max((r[k], -k) for k in range(max(0, i - 32), min(len(r), i + 33)))]

    bits = []
    for t in (text, other):
        data = t.encode()
        assert digests.features(data).tolist() == places(data)
        hashes = digests._feature_hashes(data, np.array(places(data)))
        bits.append({int(b) for row in hashes for b in row})
        assert len(hashes) <= digests.FEATURES
    x, y = map(len, bits)
    chance = x * y / 2048
    cut = chance + 4 * (chance * (1 - x / 2048) * (1 - y / 2048)) ** 0.5
    expected = max(0.0, (len(bits[0] & bits[1]) - cut) / (min(x, y) - cut))
    assert digests.likeness(digests.digest(text), digests.digest(other)) == pytest.approx(expected, abs=1e-5) and expected > 0.3


def test_sketches_bound_the_difference():
    """Folded or not, sketches differ in no more bits than the sets in hashes, and tell far sets apart."""
    rng = np.random.default_rng(8)
    for n, m, both in ((30, 40, 20), (700, 500, 450), (5000, 4100, 4000), (5000, 4100, 10), (0, 3, 0)):
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        apart = len(np.setxor1d(a, b))
        found = similar.sketch_distance(similar.parity(a), similar.parity(b))
        assert apart / 4 <= found <= apart


def test_learned_marks(spark):
    """Counted one row at a time: copies of a clause once, shares by the interval's lower end, repeats of other marks left out."""
    import math
    import re

    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        toxic = i % 3 == 0
        words = [f"w{chr(97 + int(c))}{chr(97 + int(d))}x" for c, d in rng.integers(0, 12, (8, 2))]
        if toxic and rng.random() < 0.5:
            words.insert(3, "grumpf" + chr(97 + i % 7))
        if rng.random() < 0.04:
            words.insert(0, "zonk")
        rows.append((i, " ".join(words) + ". " + " ".join(words[:2]), int(toxic)))
    rows += [(1000 + i, "copied blorb clause; other", 1) for i in range(30)] + [(2000, None, 1), (2001, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.learned_insults(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), 10_000)

    seen = {}
    for doc, text, toxic in rows:
        first = {}
        for clause in re.split(r"[.!?;:|\n\r]", (text or "").lower()):
            h = xxhash.xxh64(clause.encode(), seed=42).intdigest()
            h -= (h >> 63) << 64
            for w in re.findall(r"[^\W\d_]+", clause):
                for e in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]:
                    first[e] = min(first.get(e, h), h)
        for e, h in first.items():
            seen.setdefault(e, {}).setdefault(h, []).append(toxic)

    def low(bad, n):
        z2, p = 1.96**2, bad / n
        return (p + z2 / 2 / n - 1.96 * math.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n)

    marks = []
    for e, hs in seen.items():
        bad, n = sum(min(t) for t in hs.values()), len(hs)
        if len(e) > 2 and low(bad, n) > 0.6:
            marks.append((e, bad, n))
    assert found == toxicity.distinct_marks(marks)
    assert found[1] == ["grumpf"] and "blorb" not in found[0] and "zonk" not in found[0]
    assert toxicity.distinct_marks([("idiot", 9, 9), ("idio*", 9, 9), ("trash", 8, 8), ("tras*", 12, 12), ("trashe*", 7, 7)]) == (["idiot"], ["tras"])


def test_shuffled_contamination(spark):
    """Beyond the broadcast the exchanged bytes follow the text, not the square of its length, and the tables on the way go."""
    import os

    from strandline.llm.common import shared_folder

    store = spark._jsparkSession.sharedState().statusStore()

    def moved(words):
        docs = spark.createDataFrame([(1, " ".join(f"w{i * 7919 % 100003}" for i in range(words)))], "doc_id long, text string")
        bench = spark.createDataFrame([(5, " ".join(f"w{i * 7919 % 100003}" for i in range(20, 60)))], "item_id long, text string")
        before = store.executionsCount()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert decontaminate.contamination(docs, bench, broadcast_rows=0).first()._hit.n_hit == 40
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        total = 0.0
        for i in range(before, store.executionsCount()):
            e = store.executionsList().apply(i)
            values = store.executionMetrics(e.executionId())
            for m in (e.metrics().apply(j) for j in range(e.metrics().size())):
                if m.name() == "shuffle bytes written" and values.contains(m.accumulatorId()):
                    number, unit = values.apply(m.accumulatorId()).split("\n")[-1].split("(")[0].split()[:2]
                    total += float(number.replace(",", "")) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[unit]
        return total

    left = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    small, large = moved(4000), moved(16_000)
    assert 0 < large < 8 * small and large < 20e6  # 100 KB of text
    assert {n.split("-")[1] for n in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - left} <= {"hits"}


def test_repeats_of_text_ids(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError):
        repeats.remove_repeats(docs)
    assert repeats.remove_repeats(docs.selectExpr("cast(1 as int) as doc_id", "text")).first().n_bytes == 1
