"""Responses, agreement, evidence rules and chains on small series worked out by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.operators import chains, evidence
from strandline.operators.summaries import kappa
from strandline.plans import burden, response

DAYS = [date(2025, 1, 15), date(2025, 3, 20), date(2025, 5, 22), date(2025, 7, 24)]


@pytest.fixture(scope="module")
def split(spark):
    """A lung lesion, and a liver lesion whose machine tracks are split after the first scan."""
    rows = [("p", "lung", d, float(mm)) for d, mm in zip(DAYS, (55, 46, 38, 34), strict=True)]
    rows += [("p", "liver_a", DAYS[0], 40.0)] + [("p", "liver_b", d, float(mm)) for d, mm in zip(DAYS[1:], (32, 26, 24), strict=True)]
    events = spark.createDataFrame([(*r, "present") for r in rows], "subject string, track string, day date, mm double, assertion string")
    members = spark.createDataFrame([("p", "lung", "lung"), ("p", "liver", "liver_a"), ("p", "liver", "liver_b")], "subject string, lesion string, track string")
    selections = spark.createDataFrame([("p", "lung", "lung", 55.0, False), ("p", "liver", "liver", 40.0, False)], "subject string, lesion string, organ string, baseline_mm double, nodal boolean")
    return events, members, selections


def test_both_sides_of_a_false_split(split):
    naive = response.naive_side(*split).orderBy("day").collect()
    assert [(r.sld, r.response) for r in naive] == [(95, "SD"), (86, "PD"), (78, "SD"), (74, "SD")]
    confirmed = response.confirmed_side(*split).orderBy("day").collect()
    assert [(r.sld, r.response) for r in confirmed] == [(95, "SD"), (78, "SD"), (64, "PR"), (58, "PR")]
    assert [tuple(r) for r in response.contrast(*split).collect()] == [("p", "PD", "PR", True)]


def test_no_contrast_without_a_merge(split):
    events, members, selections = split
    lung = selections.where("lesion = 'lung'")
    assert [tuple(r) for r in response.contrast(events, members, lung).collect()] == [("p", "PR", None, False)]
    assert [tuple(r) for r in response.contrast(events.limit(0), members, selections).collect()] == [("p", "NE", "NE", False)]
    assert response.contrast(events, members, selections.limit(0)).count() == 0


def test_long_series(spark):
    values = {"lung": (52, 46, 40, 34, 29, 26, 26, 27, 29, 31, 34), "liver": (40, 35, 30, 26, 22, 20, 20, 21, 22, 23, 26), "mets": (28, 24, 21, 18, 15, 14, 14, 14, 15, 16, 18)}
    rows = [("p", t, date(2024, 2, 5) + timedelta(weeks=8 * i), float(v), False) for t, vs in values.items() for i, v in enumerate(vs)]
    own = spark.createDataFrame(rows, "subject string, lesion string, day date, mm double, nodal boolean")
    targets = own.groupBy("subject", "lesion", "nodal").agg(F.min_by("mm", "day").alias("baseline_mm"))
    out = burden.assess(own, targets, own.limit(0).select("subject", "day")).orderBy("day").collect()
    assert [r.sld for r in out] == [120, 105, 91, 78, 66, 60, 60, 62, 66, 70, 78] and min(r.nadir_sld for r in out) == 60
    assert [r.response for r in out] == ["SD"] * 3 + ["PR"] * 7 + ["PD"]


def test_classes_at_their_bounds(spark):
    cases = [(70.0, 100.0, 70.0, False, False, "PR"), (60.0, 100.0, 50.0, False, False, "PD"), (54.0, 100.0, 45.0, False, False, "PD"), (24.0, 100.0, 20.0, False, False, "PR"),
             (50.0, 100.0, 50.0, True, False, "PD"), (9.0, 100.0, 9.0, False, True, "CR"), (10.0, 0.0, 10.0, False, False, "NE"), (6.0, 100.0, 0.0, False, False, "PR"), (71.0, 100.0, 71.0, False, False, "SD")]
    rows = spark.createDataFrame([c[:5] for c in cases], "sld double, base double, nadir double, fresh boolean, complete boolean")
    got = rows.select(burden.classify(F.col("sld"), F.col("base"), F.col("nadir"), F.col("fresh"), F.col("complete"))).collect()
    assert [r[0] for r in got] == [c[5] for c in cases]


def test_nodes(spark):
    """A node can be normal without being gone, is measured by its short axis and counts as a target from 15 mm on."""
    own = spark.createDataFrame([("p", "node", DAYS[0], 18.0), ("p", "node", DAYS[1], 9.0), ("p", "lung", DAYS[0], 12.0), ("p", "lung", DAYS[1], 0.0)], "subject string, lesion string, day date, mm double")
    targets = spark.createDataFrame([("p", "node", 18.0, True), ("p", "lung", 12.0, False)], "subject string, lesion string, baseline_mm double, nodal boolean")
    assert [r.response for r in burden.assess(own, targets, own.limit(0).select("subject", "day")).orderBy("day").collect()] == ["SD", "CR"]
    names = spark.createDataFrame([("lymph_node_metastasis", None), ("Pulmonary nodule", "lung"), (None, "mediastinal NODE"), (None, None)], "a string, b string")
    assert [r[0] for r in names.select(burden.is_nodal("a", "b")).collect()] == [True, False, True, False]
    axes = spark.createDataFrame([(None, None, [30.0, 12.0], True), (None, None, [30.0, 12.0], False), (7.0, 8.0, [1.0], True), (None, 8.0, None, True), (None, None, [], False)], "n double, v double, a array<double>, nodal boolean")
    assert [r[0] for r in axes.select(burden.diameter("n", "v", "a", "nodal")).collect()] == [12.0, 30.0, 7.0, 8.0, None]
    measured = spark.createDataFrame([("p", "n1", "x", True, DAYS[0], 14.9), ("p", "n2", "x", True, DAYS[0], 15.0), ("p", "l1", "y", False, DAYS[0], 10.0), ("p", "l2", "y", False, DAYS[0], 9.9)], "subject string, lesion string, organ string, nodal boolean, day date, mm double")
    assert {r.lesion for r in burden.select_targets(measured).collect()} == {"n2", "l1"}
    picked = spark.createDataFrame([("a", "L", 20.0, False)] * 3 + [("b", "o", 14.0, True), ("b", None, 20.0, False), ("c", "q", 0.0, True)], "subject string, organ string, baseline_mm double, nodal boolean")
    assert {tuple(r) for r in response.selection_faults(picked).collect()} == {("a", "too_many_per_organ"), ("b", "node_target_too_small")}
    small = spark.createDataFrame([("a", "x", 9.0, False), ("a", "y", 14.0, True), ("a", "z", 14.0, None)], "subject string, organ string, baseline_mm double, nodal boolean")
    some = spark.createDataFrame([("a",), ("n",)], "subject string")
    assert {tuple(r) for r in response.selection_faults(small, some).collect()} == {("a", "target_too_small"), ("a", "node_target_too_small"), ("n", "no_targets")}


def test_agreement(spark):
    cells = [("y", "y", 20), ("y", "n", 5), ("n", "y", 10), ("n", "n", 15)]
    pairs = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    assert tuple(kappa(pairs, "a", "b").first()) == (50, 0.7, 0.5, 0.4)
    same = spark.createDataFrame([("y", "y"), ("n", "n")], "a string, b string")
    assert kappa(same, "a", "b").first().kappa == 1.0
    assert kappa(same.where("a = 'y'"), "a", "b").first().kappa is None  # chance agreement is full
    blank = spark.createDataFrame([(None, None), ("y", None), ("y", "y")], "a string, b string")
    assert kappa(blank, "a", "b").first().n_items == 3
    assert kappa(blank.limit(0), "a", "b").first().n_items == 0


def test_evidence_rules(spark):
    rows = [("absent", "fracture", "No fracture", True), ("absent", "cardiomegaly", "Heart size normal.", True), ("absent", "fracture", "heart size normal", False), ("present", "x", "mass without change", False),
            ("present", "x", None, True), ("uncertain", "x", "May represent scar", True), ("uncertain", "x", "scar", False), ("not_mentioned", "x", "", True)]
    frame = spark.createDataFrame([r[:3] for r in rows], "a string, t string, e string")
    assert [r[0] for r in frame.select(evidence.assertion_supported(F.col("a"), F.col("t"), F.col("e"))).collect()] == [r[3] for r in rows]
    texts = spark.createDataFrame([("Pleural-effusion, left",), ("effusions",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(evidence.mentions_any(F.col("t"), ("pleural_effusion", "effusion"))).collect()] == [True, False, False, False]
    sizes = spark.createDataFrame([(10.0, 11.0), (10.0, 11.1), (10.0, 8.9), (0.0, 5.0), (None, 5.0), (5.0, None)], "p double, c double")
    assert [r[0] for r in sizes.select(evidence.measurement_change(F.col("p"), F.col("c"))).collect()] == ["stable", "increased", "decreased", None, None, None]
    scores = spark.createDataFrame([("Confirmed", None), ("x", None), (None, None), ("x", 3.0), ("x", -1.0)], "l string, g double")
    assert [r[0] for r in scores.select(evidence.certainty_score(F.col("l"), F.col("g"))).collect()] == [0.96, 0.5, 0.5, 1.0, 0.0]


def test_chains(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, None), ("k", 3, "c")], "key string, at int, v string")
    out = chains.chained(rows, ["key"], ["at"], ["at", "v"])
    got = {(r.key, r["at"]): (r.prev_hash, r.row_hash) for r in out.collect()}
    first, second = sha("GENESIS|1|a"), sha(sha("GENESIS|1|a") + "|2|b")
    assert got["k", 1] == (None, first) and got["k", 2] == (first, second) and got["k", 3][0] == second and got["j", 1] == (None, sha("GENESIS|1|"))
    assert chains.chain_faults(out, ["key"], ["at"], ["at", "v"]).count() == 0
    forked = out.withColumn("prev_hash", F.when(F.col("at") == 3, first).otherwise(F.col("prev_hash")))
    assert {(r["at"], r.fault) for r in chains.chain_faults(forked, ["key"], ["at"], ["at", "v"]).collect()} == {(3, "broken_linkage"), (3, "fork"), (3, "row_hash_mismatch")}
