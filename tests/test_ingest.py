"""Items become reports and versions as if added one at a time."""

import hashlib
import random
from datetime import date

from strandline.operators import ingest

ITEM = "org string, patient int, nth int, note string, day date, kind string, text string"
REPORT = "org string, patient int, report string, note string, day date, kind string"
VERSION = "org string, patient int, nth int, report string, version long, text string, digest string, addendum boolean"


def test_batches(spark):
    rng = random.Random(6)
    item = lambda n: (rng.choice("xy"), rng.randrange(3), n, rng.choice(["n1", "n2", "n3", "", None]), date(2024, 1, 1 + n % 28), rng.choice(["CT", "", None]), rng.choice(["a", "b", None]))
    items = [item(n) for n in range(90)]
    known, want, first = {}, {}, {}
    for org, patient, n, note, day, kind, text in items:
        key = (org, patient, note or n)
        known[key] = known.get(key, 0) + 1
        first.setdefault(key, (day, kind or "RR"))
        want[n] = (known[key], known[key] > 1, hashlib.sha256((text or "").encode()).hexdigest())
    reports, versions = spark.createDataFrame([], REPORT), spark.createDataFrame([], VERSION)
    for at in (0, 30, 60):
        rows = items[at : at + 30]
        rng.shuffle(rows)
        new, more = ingest.add_reports(spark.createDataFrame(rows, ITEM), reports, versions)
        reports = spark.createDataFrame([*reports.collect(), *new.select(reports.columns).collect()], REPORT)
        versions = spark.createDataFrame([*versions.collect(), *more.select(versions.columns).collect()], VERSION)
    assert {r.nth: (r.version, r.addendum, r.digest) for r in versions.collect()} == want
    assert sorted((r.day, r.kind) for r in reports.collect()) == sorted(first.values())
    assert versions.select("org", "report").distinct().count() == reports.count() == len(first)
    bare = spark.createDataFrame([("x", 1, "none", "n9", date(2024, 1, 1), "CT")], REPORT)
    listed = ingest.with_current(reports.unionByName(bare), versions).collect()
    assert sum(r.n_versions for r in listed) == 90 and [(r.version, r.n_versions) for r in listed if r.report == "none"] == [(None, 0)]


def test_empty(spark):
    new, more = ingest.add_reports(spark.createDataFrame([], ITEM), spark.createDataFrame([], REPORT), spark.createDataFrame([], VERSION))
    assert new.count() == more.count() == 0
