"""Linking on series worked out by hand, pairs against brute force over the rules, intervals against resampled items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import agreement
from strandline.plans import linking

KIND = "subject string, report_id string, report_date string, frame_index int, finding_type string, anatomy string, laterality string, assertion string, lesion_key string, finding_surface string, evidence_text string, source_kind string, review_only boolean"


def events(spark, rows):
    """rows: (date, finding_type, anatomy, laterality, lesion_key)."""
    return spark.createDataFrame([("p", f"r{d}", d, i, t, a, s, "present", k, None, None, "checklist", False) for i, (d, t, a, s, k) in enumerate(rows)], KIND)


def decided(frame):
    return [(r.track_key, r.link_decision) for r in linking.link_events(frame).orderBy("frame_index").collect()]


def test_decisions(spark):
    got = decided(events(spark, [
        ("2024-01-01", "Pleural-effusion", "thorax", "right", None),
        ("2024-02-01", "pleural effusion", "pleural space", "right", None),
        ("2024-02-01", "pleural effusion", "pleural space", "left", None),
        ("2024-03-01", "pleural effusion", "pleural space", "unknown", None),
        ("2024-03-01", "fracture", "rib", None, None),
        ("2024-04-01", "fracture", "bone", "", None),
        ("2024-04-01", "fracture", None, "", None),
        ("2024-05-01", "fracture", "rib", "", "L1"),
        ("2024-05-02", "fracture", "thorax", "left", "L1"),
        ("2024-05-03", "fracture", "rib", "left", "unresolved link"),
    ]))
    right, left = "pleural_effusion|pleural_space|right", "pleural_effusion|pleural_space|left"
    assert got == [
        (right, "new_track"), (right, "exact_key"), (left, "new_track"),
        ("pleural_effusion|pleural_space|unknown|unresolved_link|r2024-03-01|checklist|3", "ambiguous_compatible_tracks"),
        ("fracture|rib|unknown", "new_track"), ("fracture|rib|unknown", "compatible_merge"), ("fracture|unknown|unknown", "new_track"),
        ("fracture|rib|unknown|L1".lower(), "new_track"), ("fracture|rib|unknown|l1", "compatible_merge"),
        ("fracture|rib|left|unresolved_link|r2024-05-03|checklist|9", "explicit_unresolved_link"),
    ]


def test_order_is_not_that_of_rows(spark):
    rows = [("2024-02-01", "fracture", "rib", "", None), ("2024-01-01", "fracture", "bone", "", None)]
    assert decided(events(spark, rows)) == [("fracture|bone|unknown", "compatible_merge"), ("fracture|bone|unknown", "new_track")]


def test_catch_all_and_nothing(spark):
    frame = events(spark, [("2024-01-01", "other important finding", "lung", "left", None)] * 2)
    assert [d for _, d in decided(frame)] == ["new_track", "new_track"] and len({k for k, _ in decided(frame)}) == 2
    assert linking.link_events(frame.limit(0)).count() == 0
    assert linking.link_events(frame.withColumn("subject", F.lit(None).cast("string"))).count() == 2


def test_compatible_sites():
    assert linking.anatomy_compatible("rib", "thorax") and linking.anatomy_compatible("abdomen", "renal_collecting_system") and not linking.anatomy_compatible("rib", "liver")
    assert linking.anatomy_compatible("unknown", "unknown") and not linking.anatomy_compatible("unknown", "rib")
    assert linking.laterality_compatible("left", "") and not linking.laterality_compatible("left", "right")


def one_by_one(rows):
    """rows: keyed events as dicts, of one subject. The rules over a plain list of all tracks so far: [(report_id, frame_index, key, decision, candidates)]."""
    tracks, out = [], []
    for e in sorted(rows, key=lambda e: (e["report_date"] or "", e["report_id"] or "", e["frame_index"] or 0)):
        fits = {t["key"] for t in tracks if (t["kind"], t["family"], t["lesion"]) == (e["_kind"], e["link_family"], e["_lesion"]) and linking.anatomy_compatible(e["link_anatomy"], t["anatomy"]) and linking.laterality_compatible(e["link_laterality"], t["side"]) and (e["_lesion"] or not (t["catch_all"] or e["_catch_all"]))}
        base = e["base_track_key"]
        apart = f"{base}|unresolved_link|{e['_identity']}"
        if e["_unresolved"]:
            key, decision = apart, "explicit_unresolved_link"
        elif not fits:
            key, decision = base, "new_track"
        elif base in fits or len(fits) == 1:
            key, decision = (base, "exact_key") if base in fits else (*fits, "compatible_merge")
        else:
            key, decision = apart, "ambiguous_compatible_tracks"
        if key != apart:
            # a track has the site and side of its last event
            tracks = [t for t in tracks if t["key"] != key or (t["kind"], t["family"], t["lesion"]) != (e["_kind"], e["link_family"], e["_lesion"])]
            tracks.append({"key": key, "kind": e["_kind"], "family": e["link_family"], "lesion": e["_lesion"], "anatomy": e["link_anatomy"], "side": e["link_laterality"], "catch_all": e["_catch_all"]})
        out.append((e["report_id"], e["frame_index"] or 0, key, decision, [] if decision == "new_track" else sorted(fits)))
    return out


def test_linker_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    rows = [(f"s{i % 4}", pick(None, "a", "b"), pick(None, "2024-01-01", "2024-02-01"), i, pick("fracture", "pleural effusion", "other important finding", "device or line"), pick("rib", "bone", "thorax", "", None), pick("left", "right", "", None), pick("present", "absent"), pick(None, None, "L1", "unresolved link"), pick("EKG leads", "tip"), None, pick("checklist", "catch all"), pick(False, False, True)) for i in range(300)]
    frame = spark.createDataFrame(rows, KIND)
    keyed = [r.asDict() for r in linking.event_keys(frame).collect()]
    want = [(s, *r) for s in sorted({r["subject"] for r in keyed}) for r in one_by_one([k for k in keyed if k["subject"] == s])]
    got = [(r.subject, r.report_id, r.frame_index, r.track_key, r.link_decision, r.candidates) for r in linking.link_events(frame).collect()]
    assert sorted(got, key=lambda r: (r[0], r[2])) == sorted(want, key=lambda r: (r[0], r[2]))
    assert {r[4] for r in got} == {"new_track", "exact_key", "compatible_merge", "explicit_unresolved_link", "ambiguous_compatible_tracks"}
    first = events(spark, [("2024-01-01", "fracture", "rib", "", None)] * 2).withColumn("report_id", F.when(F.col("frame_index") == 0, "a")).withColumn("frame_index", F.lit(1))
    assert [(r.report_id, r.link_decision) for r in linking.link_events(first).orderBy("link_decision").collect()] == [("a", "exact_key"), (None, "new_track")]


def test_pairs_by_brute_force(spark):
    sites, sides = ["rib", "thorax", "bone", "kidney", "abdomen", "unknown", "heart"], ["left", "right", "unknown", "not_applicable"]
    rows = [("p", f"{k}|{a}|{s}", k, a, s) for k in ("x", "other_important_finding") for a in sites for s in sides] + [("q", "x|rib|left", "x", "rib", "left")]
    got = {tuple(r) for r in linking.false_splits(spark.createDataFrame(rows, "subject string, track_key string, _kind string, link_anatomy string, link_laterality string")).collect()}
    expected = {("p", a[1], b[1]) for a in rows for b in rows if a[0] == b[0] == "p" and a[2] == b[2] == "x" and a[1] < b[1] and linking.anatomy_compatible(a[3], b[3]) and linking.laterality_compatible(a[4], b[4])}
    assert got == expected and len(got) > 20


def test_intervals(spark):
    """Near those of items drawn one by one; a table with one category has none."""
    rng = np.random.default_rng(1)
    a = rng.choice(["x", "y", "z"], 150)
    b = np.where(rng.random(150) < 0.7, a, rng.choice(["x", "y", "z"], 150))
    pairs = spark.createDataFrame([("s", str(x), str(y)) for x, y in zip(a, b, strict=True)] + [("t", "x", "x")] * 9, "slot string, a string, b string")
    got = {r.slot: (r.low, r.high) for r in agreement.bootstrap_intervals(pairs).collect()}

    def kappa(x, y):
        po = (x == y).mean()
        pe = sum((x == c).mean() * (y == c).mean() for c in "xyz")
        return (po - pe) / (1 - pe)

    drawn = [kappa(a[i], b[i]) for i in (rng.integers(0, 150, 150) for _ in range(2000))]
    assert got["s"] == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.03)
    assert got["t"][0] is None or np.isnan(got["t"][0])


def test_slots_of_a_pair(spark):
    left = spark.createDataFrame([(1, {"anatomy": "a", "assertion": "p", "zz": "1"}), (2, {"anatomy": "b", "assertion": None}), (3, {"anatomy": "c"}), (4, {})], "item int, labels map<string,string>")
    right = spark.createDataFrame([(1, {"anatomy": "a", "assertion": "p"}), (2, {"anatomy": "b", "assertion": "n", "zz": "1"}), (3, None), (5, {"anatomy": "a"})], "item int, labels map<string,string>")
    got = {(r.slot, r.n_items, r.kappa) for r in agreement.scored_pair(left, right).collect()}
    assert got == {("anatomy", 2, 1.0), ("assertion", 2, 0.333333), (agreement.COMPOSITE, 2, 0.333333)}
