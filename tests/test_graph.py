"""The graph of tracks against its rules over plain lists."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandline.plans import graph

TRACKS = "subject int, track string, kind string, anatomy string"
EVENTS = "subject int, track string, nth int, report string, assertion string, change string, review_only boolean, start int, end int"


def families(anatomy, named):
    a = anatomy.lower().strip()
    return next((name for name, words in named if a in words or any(len(w) > 3 and w in a for w in words)), a)


def brute(tracks, events, near=200):
    out = []
    low = lambda x: (x or "").lower()
    counted = [e for e in events if not e[6]]
    telling = {(e[0], e[1]) for e in counted if low(e[4]) not in graph.INACTIVE or low(e[5]) in graph.SALIENT}
    active = {(t[0], t[1]): t for t in tracks if (t[0], t[1]) in telling and low(t[2]) not in graph.LOW_SALIENCE}
    own = {k: [e for e in counted if (e[0], e[1]) == k and e[3]] for k in active}
    label = lambda change, named, default: next((n for n, words in named if low(change) in words), default)

    def number(e):
        digits = e[3].replace("report_", "")
        return (int(digits) if digits.lstrip("-").isdigit() else 0, e[2])

    moves = {}
    for k, rows in own.items():
        rows = sorted(rows, key=number)
        moves[k] = {}
        for a, b in zip(rows, rows[1:], strict=False):
            out.append((*k, k[1], "progression", label(b[5], graph.SUBTYPES, "unknown"), 1.0, (a[3], b[3])))
            moves[k][a[3], b[3]] = label(b[5], graph.DIRECTIONS, "stable")
    near_by = {frozenset((n, o)) for n, others in graph.NEIGHBOURS for o in others}
    for a, b in combinations(sorted(active), 2):
        if a[0] != b[0]:
            continue
        shared = sorted(moves[a].keys() & moves[b].keys())
        alike = [i for i in shared if moves[a][i] == moves[b][i]]
        if active[a][2] != active[b][2] and len(shared) >= 2 and alike:
            kinds = [moves[a][i] for i in alike]
            top = max(("worsening", "improving", "stable"), key=kinds.count)
            out.append((*a, b[1], "coevolution", f"co_{top}", round(len(alike) / len(shared), 4), tuple("->".join(i) for i in alike)))
        x, y = low(active[a][3]), low(active[b][3])
        if x not in graph.NO_PLACE and y not in graph.NO_PLACE:
            organs, regions = [families(z, graph.ORGANS) for z in (x, y)], [families(z, graph.REGIONS) for z in (x, y)]
            tier = ("same_organ", 1.0) if organs[0] == organs[1] else None
            if not tier and regions[0] == regions[1]:
                tier = ("adjacent", 0.8) if frozenset(organs) in near_by else ("same_region", 0.6)
            if tier:
                out.append((*a, b[1], "anatomical", *tier, (f"anatomy:{x}", f"anatomy:{y}")))
        for e in own[a]:
            for f in own[b]:
                off = [low(z[4]) in graph.INACTIVE for z in (e, f)]
                if e[3] != f[3] or all(off):
                    continue
                strength = 0.5
                if all(z is not None and z >= 0 for z in (*e[7:9], *f[7:9])):
                    apart = min(abs(f[7] - e[8]), abs(e[7] - f[8]), abs(f[7] - e[7]))
                    if apart > near:
                        continue
                    strength = max(0.0, 1 - apart / 200)
                out.append((*a, b[1], "proximity", "present_with_negative" if any(off) else "co_present", round(strength, 4), (e[3],)))
    return out, active


@pytest.mark.parametrize("seed", [1, 2])
def test_graph(spark, seed):
    rng = random.Random(seed)
    kinds, places = ["nodule", "effusion", "device_or_line", None], ["Lung", "right kidney", "hepatic", "", None, "any", "rib", "heart", "scalp", "GI", "pleural space", "gallbladder"]
    tracks = [(s, f"t{i}", rng.choice(kinds), rng.choice(places)) for s in range(3) for i in range(12)] + [(9, "alone", "nodule", "lung"), (8, "quiet", "nodule", "lung")]
    events = [(8, "quiet", 0, "report_1", "absent", None, False, 1, 2)]
    for s, track, *_ in tracks[:36]:
        for n in range(rng.randrange(9)):
            start = rng.choice([None, -1, *(rng.randrange(1500) for _ in range(8))])
            end = rng.choice([None, start, start + rng.randrange(400)]) if start is not None else None
            report = rng.choice(["report_2", "report_10", "report_2", "report_1", "x", "", None])
            events.append((s, track, n, report, rng.choice(["Present", "absent", "not_mentioned", None]), rng.choice(["new", "Stable", "worsened", "resolved", "improved", None, "odd"]), rng.choice([False, False, False, True, None]), start, end))
    edges, figures = graph.track_graph(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(events, EVENTS))
    want, active = brute(tracks, events)
    got = [(r.subject, r.source, r.target, r.type, r.subtype, r.strength, tuple(r.evidence)) for r in edges.collect()]
    assert sorted(got) == sorted(want)
    for r in figures.collect():
        mine = [e for e in want if e[0] == r.subject]
        n = sum(k[0] == r.subject for k in active)
        between = sum(e[3] != "progression" for e in mine)
        assert (r.n_active, r.n_edges, r.n_proximity) == (n, len(mine), sum(e[3] == "proximity" for e in mine))
        assert r.density == (round(between / (n * (n - 1) / 2), 6) if n > 1 else 0)


def test_a_long_report_meets_only_what_is_near(spark):
    """20,000 events of one report, each 1,000 characters from the next but for its neighbour: pairs looked at stay few."""
    rows = spark.range(20_000).select(F.lit(1).alias("subject"), F.concat(F.lit("t"), "id").alias("track"), F.lit(0).alias("nth"), F.lit("report_1").alias("report"), F.lit("present").alias("assertion"),
                                      F.lit("new").alias("change"), F.lit(False).alias("review_only"), (F.floor(F.col("id") / 2) * 1000 + F.col("id") % 2 * 50).cast("int").alias("start"))
    edges = graph.proximity(rows.withColumn("end", F.col("start") + 10))
    assert edges.agg(F.count("*"), F.min("strength"), F.max("strength")).first()[:] == (10_000, 0.8, 0.8)


def test_empty(spark):
    edges, figures = graph.track_graph(spark.createDataFrame([], TRACKS), spark.createDataFrame([], EVENTS))
    assert edges.count() == figures.count() == 0
