"""Word errors and absorbed findings against their rules over plain lists."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF
from strandline.functions import errors
from strandline.operators import containment


def spoken(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()


def table_of(a, b):
    """(errors, deleted, inserted) of the whole table, the least triple of each cell."""
    row = [(j, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i, 0)]
        for j, y in enumerate(b, 1):
            add = lambda c, s, d, n: (c[0] + s, c[1] + d, c[2] + n)
            new.append(min(add(row[j - 1], int(x != y), 0, 0), add(row[j], 1, 1, 0), add(new[j - 1], 1, 0, 1)))
        row = new
    return row[-1]


def test_edits(spark):
    rng = random.Random(3)
    draw = lambda most: [rng.choice("abcde") for _ in range(rng.randrange(most))]
    pairs = [(draw(12), draw(12)) for _ in range(150)] + [([], []), (["a"], []), ([], ["a", "b"]), (draw(90), draw(4)), (draw(4), draw(90))]
    found = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", errors.edits(F.col("a"), F.col("b")).alias("e")).collect()
    for r in found:
        total, deleted, inserted = table_of(r.a, r.b)
        assert tuple(r.e) == (total, total - deleted - inserted, deleted, inserted)


def test_spoken(spark):
    texts = ["  Don't\tstop -- NOW! ok", "Éa_b, c\n\u0085d", "", "!?", "x\u001cy", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(errors.spoken(F.col("t"))).collect()]
    assert found == [spoken(t or "") for t in texts]


def test_scores(spark):
    rows = [("The nodule, is stable", "the nodule stable", ["Nodule", "mass"], "x", None), ("a b", "", [], "x", None), ("a b", None, None, "y", None), ("", "a", ["a"], "y", None), ("", "!", None, "y", None), ("a", "b", [], None, "failed")]
    scores = errors.scored(spark.createDataFrame(rows, "said string, heard string, names array<string>, context string, error string"))
    assert [(r.rate, r.recall) for r in scores.collect()] == [(0.25, 0.5), (1.0, 1.0), (1.0, 1.0), (None, 1.0), (0.0, 1.0), (1.0, 1.0)]
    got = {r.context: (r.n_samples, r.n_valid, r.rate, r.recall) for r in errors.summary(scores, "context").collect()}
    assert got == {"x": (2, 2, 0.625, 0.75), "y": (3, 2, 0.5, 1.0), None: (6, 4, 0.5625, 0.875)}


def test_long_texts(spark):
    """A pair of 800 words: only diagonals are held."""
    a = F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: (i % 97).cast("string"))
    e = spark.range(1).select(errors.edits(a, F.slice(a, 11, 790)).alias("e")).first()[0]
    assert tuple(e) == (10, 0, 10, 0)


def test_time_of_long_texts(spark):
    """A pair of 6,000 words, 36 million cells, takes seconds, and lists may be null or hold nulls."""
    a = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.concat(F.lit("w"), i * i % 1999))
    start = time.monotonic()
    e = spark.range(1).select(errors.edits(a, F.slice(a, 1001, 5000)).alias("e")).first()[0]
    assert tuple(e) == (1000, 0, 1000, 0) and time.monotonic() - start < 60
    odd = spark.createDataFrame([(None, ["a"]), (["a"], None), (["a", None], ["a", "b", None])], "a array<string>, b array<string>")
    assert [r[0] and tuple(r[0]) for r in odd.select(errors.edits(F.col("a"), F.col("b"))).collect()] == [None, None, (1, 0, 0, 1)]


def test_word_errors_of_turns(spark):
    rows = errors._turns(spark, SF).select("conv_id", "turn", "said", "heard").collect()
    found = {(r.conv_id, r.turn): (r.errors, r.deleted, r.inserted) for r in errors.word_errors(spark, SF).collect()}
    want = {(r.conv_id, r.turn): table_of(spoken(r.said).split(), spoken(r.heard).split()) for r in rows}
    assert found == want


def brute_absorb(names):
    """{nth: (parent, evidence)} by pairs in order; evidence is e0, e1, ..., none for every third."""
    sets = [set(re.sub(r"[^a-z0-9\s]", " ", (n or "").lower()).split()) - set(containment.EMPTY_WORDS) for n in names]
    told = [f"e{i}" if i % 3 else "" for i in range(len(names))]
    parent = {}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if i in parent or j in parent or min(len(sets[i]), len(sets[j])) < 2:
                continue
            if sets[j] < sets[i] or sets[i] < sets[j]:
                child, into = (j, i) if sets[j] < sets[i] else (i, j)
                text = told[child] or names[child] or ""
                if text and text not in told[into]:
                    told[into] = f"{told[into]}; {text}" if told[into] else text
                parent[child] = into
    return {i: (parent.get(i), told[i]) for i in range(len(names))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_absorb(spark, seed):
    rng = random.Random(seed)
    name = lambda: " ".join(rng.choice(["Rib", "fracture", "right", "sixth", "the", "no", "old-healed"]) for _ in range(rng.randrange(1, 6)))
    groups = {g: [rng.choice([name(), name(), name(), None, ""]) for _ in range(25)] for g in range(4)}
    rows = [(g, i, n, f"e{i}" if i % 3 else rng.choice(["", None])) for g, names in groups.items() for i, n in enumerate(names)]
    found = containment.absorb(spark.createDataFrame(rows, "report int, nth int, name string, evidence string"), "report").collect()
    got = {(r.report, r.nth): (r.parent, r.told) for r in found}
    want = {(g, i): v for g, names in groups.items() for i, v in brute_absorb(names).items()}
    assert len(found) == len(rows) and got == want


def test_a_word_that_all_sets_hold(spark):
    """4,000 sets share a word; each meets others only under its own rare one."""
    rows = spark.range(4000).select(F.lit(1).alias("g"), F.array(F.lit("all"), F.concat(F.lit("w"), F.floor(F.col("id") / 2)), *[F.when(F.col("id") % 2 == 1, "x")]).alias("w"))
    links = containment.contained(rows.select("g", F.array_sort(F.array_compact("w")).alias("words")), "g")
    assert links.count() == 2000
