"""The replay of decisions against one row by row, on hand series and random logs."""

import hashlib
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.functions import canonical
from strandline.plans import decisions

KIND = "subject string, decision_id int, decided_at timestamp, decision string, primary_track string, related_tracks array<string>, resulting_track string, rationale string, decided_by string"
START = datetime(2025, 1, 1)


def log_of(spark, *rows):
    """rows: (decision, primary, related, result), in order, of subject p."""
    return spark.createDataFrame([("p", i, START + timedelta(hours=i), d, a, r, k, None, "u") for i, (d, a, r, k) in enumerate(rows)], KIND)


def one_by_one(rows):
    """Members after each decision in turn: {(subject, identity, track)}."""
    inside, barred = set(), set()
    for subject, _, _, kind, track, related, result, *_ in sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1])):
        key = result or track
        if kind in ("reject", "mark_unresolved"):
            barred.add((subject, track))
            inside = {m for m in inside if (m[0], m[2]) != (subject, track)}
        elif kind in ("confirm", "split", "merge"):
            inside |= {(subject, key, t) for t in [track, *(related or [] if kind == "merge" else [])] if t is not None}
            if kind != "split":
                barred.discard((subject, track))
    return {m for m in inside if (m[0], m[2]) not in barred}


CASES = [
    ([("confirm", "a", None, None)], {("a", "a")}),
    ([("merge", "a", ["b"], "m")], {("m", "a"), ("m", "b")}),
    ([("merge", "a", ["b"], "m"), ("reject", "a", None, None)], {("m", "b")}),
    ([("reject", "a", None, None), ("merge", "b", ["a"], "m")], {("m", "b")}),  # barred until it is a primary again
    ([("reject", "a", None, None), ("merge", "b", ["a"], "m"), ("confirm", "a", [], "k")], {("m", "b"), ("m", "a"), ("k", "a")}),
    ([("reject", "a", None, None), ("split", "a", None, "s")], set()),  # a split lifts no bar
    ([("merge", "a", ["b"], "m"), ("mark_unresolved", "b", None, None), ("merge", "a", ["b", None], "m")], {("m", "a")}),
    ([("confirm", "a", None, ""), ("reject", "a", None, None), ("confirm", "a", None, "")], {("a", "a")}),
    ([("merge", "a", ["b"], "m"), ("split", "b", ["a"], "b"), ("other", "c", None, None)], {("m", "a"), ("m", "b"), ("b", "b")}),
]


@pytest.mark.parametrize("rows, want", CASES)
def test_hand_series(spark, rows, want):
    log = log_of(spark, *rows)
    assert {(r.lesion, r.track) for r in decisions.confirmed_members(log).collect()} == want
    assert {m[1:] for m in one_by_one([tuple(r) for r in log.collect()])} == want


def test_random_logs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        at = None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(60))  # ties, and decisions without a date
        rows.append((f"s{rng.randrange(25)}", i, at, rng.choice(["confirm", "merge", "split", "reject", "mark_unresolved"]), rng.choice("abcde"), rng.choice([None, [], ["b"], ["c", None, "d"]]), rng.choice([None, "", "a", "m", "n"]), "r", "u"))
    found = decisions.confirmed_members(spark.createDataFrame(rows, KIND))
    assert sorted(map(tuple, found.collect())) == sorted(one_by_one(rows))
    assert decisions.confirmed_members(spark.createDataFrame([], KIND)).count() == 0


def test_attributes_and_faults(spark):
    log = log_of(spark, ("merge", "b", ["a", "x"], "m"), ("confirm", "y", None, None), ("?", "a", None, None))
    tracks = spark.createDataFrame([("p", "b", "nodule", "lung", "left"), ("p", "a", "mass", None, "right"), ("q", "y", "", "", "")], "subject string, track string, finding_type string, anatomy string, laterality string")
    assert sorted(tuple(r) for r in decisions.confirmed_tracks(log, tracks).collect()) == [("p", "m", ["a", "b", "x"], "mass", None, "right"), ("p", "y", ["y"], None, None, None)]
    assert sorted(tuple(r)[1:3] + (r.track or "",) for r in decisions.decision_faults(log, tracks).collect()) == [(0, "unknown_track_key", "x"), (1, "unknown_track_key", "y"), (2, "unknown_decision", "")]
    picked = spark.createDataFrame([("p", "m"), ("p", "a"), ("q", "m")], "subject string, lesion string")
    assert {tuple(r) for r in decisions.unconfirmed_targets(picked, decisions.confirmed_members(log)).collect()} == {("p", "a"), ("q", "m")}


def test_one_merge_flips_the_response(spark):
    days = [date(2025, 1, 15), date(2025, 3, 20), date(2025, 5, 22), date(2025, 7, 24)]
    rows = [("p", "lung", d, float(mm), "present") for d, mm in zip(days, (55, 46, 38, 34), strict=True)]
    rows += [("p", t, d, float(mm), "present") for t, d, mm in zip(("liver7", "liver", "liver", "liver"), days, (40, 32, 26, 24), strict=True)]
    events = spark.createDataFrame(rows, "subject string, track string, day date, mm double, assertion string")
    chosen = spark.createDataFrame([("p", "lung", "lung", 55.0, False), ("p", "liver", "liver", 40.0, False)], "subject string, lesion string, organ string, baseline_mm double, nodal boolean")
    apart = [("confirm", "lung", None, None), ("confirm", "liver", None, None)]
    merged = [*apart, ("merge", "liver7", ["liver"], "liver")]
    found = lambda *rows: [tuple(r) for r in decisions.decided_contrast(events, log_of(spark, *rows), chosen).collect()]
    assert found(*merged) == [("p", "PD", "PR", True)]
    assert found(*apart)[0][2:] == (None, False)  # nothing is merged, so there is nothing to contrast
    assert found(*merged, ("reject", "liver7", None, None))[0][2:] == (None, False)
    assert found(*merged, ("reject", "liver7", None, None), ("merge", "liver7", ["liver"], "liver")) == [("p", "PD", "PR", True)]


TEXTS = ["plain", "", None, 'a "b" \\ c', "line\nbreak\ttab\r\b\f\x00\x1f\x7f", "é漢😀 ", "'"]


def test_canonical_json(spark):
    rows = spark.createDataFrame([(t, [t or "", "x"]) for t in TEXTS] + [("n", None)], "t string, a array<string>")
    found = rows.select("t", "a", canonical.json_object(b=canonical.json_string(F.col("t")), a=canonical.json_strings(F.col("a"))).alias("j")).collect()
    for r in found:
        assert r.j == json.dumps({"b": r.t, "a": r.a or []}, sort_keys=True, separators=(",", ":"))


def test_signatures(spark):
    log = log_of(spark, ("merge", "tumör", ["b", "c"], None))
    payload = {"run_id": "p", "decision": "merge", "primary_track_key": "tumör", "related_track_keys": ["b", "c"], "resulting_track_key": None, "rationale": None, "decided_by": "u"}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert decisions.signed(log).first().signature_sha256 == want
