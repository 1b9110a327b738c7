"""The shared limiter: as the rules say, the same after a restart, late rows kept."""

import random

from pyspark.sql import functions as F

from strandline.streaming import appends, limits

COLUMNS = "key string, number int, at timestamp"


def rows_of(spark, requests):
    return spark.createDataFrame(requests, "key string, number int, s double").select("key", "number", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("at"))


def plain(batches, limit, seconds):
    """{number: (granted, wait)} by the rules, one request at a time."""
    windows, last, out = {}, {}, {}
    for batch in batches:
        for key, number, s in sorted(batch, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            now = last[key] = max(s, last.get(key, s)) if s is not None else last.get(key, 0)
            start, n = windows.get(key, (None, 0))
            if start is None or now - start >= seconds:
                windows[key], out[number] = (now, 1), (True, 0.0)
            elif n < limit:
                windows[key], out[number] = (start, n + 1), (True, 0.0)
            else:
                out[number] = (False, seconds - (now - start))
    return out


def test_limited(spark, tmp_path):
    rng = random.Random(5)
    draw = lambda i, low: (rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *(float(low + rng.randrange(300)) for _ in range(9))]))
    batches = [[draw(i + 60 * b, 200 * b) for i in range(60)] for b in range(3)]  # later batches reach back into the time of those before
    folder = str(tmp_path / "run")
    for batch in batches:  # each call is a restart of the stream on what is new
        rows_of(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(COLUMNS).parquet(f"{folder}/in")
        found = appends.run_batches(limits.limited(stream, "key", "number", "at", 3, 60), folder, "append")
    got = {r.number: (r.granted, r.wait_s) for r in found.collect()}
    assert found.count() == 180 and got == plain(batches, 3, 60)
    assert sum(not g for g, _ in got.values()) > 20


def test_limited_table(spark):
    requests = [("a", 1, 0.0), ("a", 2, 59.9), ("a", 3, 60.0), ("b", 4, 10.0), ("a", 5, 60.0)]
    found = limits.limited(rows_of(spark, requests), "key", "number", "at", 1)
    assert sorted((r.number, r.granted, round(r.wait_s, 1)) for r in found.collect()) == [(1, True, 0), (2, False, 0.1), (3, True, 0), (4, True, 0), (5, False, 60)]
    assert limits.limited(rows_of(spark, requests).limit(0), "key", "number", "at", 1).count() == 0
