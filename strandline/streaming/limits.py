"""A limiter that all workers share, as a stream with state: so many starts of a key in a window that begins with the first of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.streaming.appends import arriving, run_batches, shared_folder

SECONDS = 60  # fixed value: the window
STATE = "start long, n long, last long"


def decide(state: tuple[int, int, int] | None, at: int | None, limit: int, window: int) -> tuple[tuple[int, int, int], bool, int]:
    """(state after, whether a request may start, microseconds to wait if not). Requests that come late count at the last time seen."""
    if state is None:
        now = at or 0
        return (now, 1, now), True, 0
    start, n, last = state
    now = last if at is None else max(at, last)
    if now - start >= window:
        return (now, 1, now), True, 0
    if n < limit:
        return (start, n + 1, now), True, 0
    return (start, n, now), False, window - (now - start)


def limited(requests: DataFrame, key: str, number: str, at: str, limit: int, seconds: float = SECONDS) -> DataFrame:
    """``requests`` (key, number, at) with ``granted`` and ``wait_s``: the seconds until the window ends, 0 if granted. For streams and tables.

    A window begins with the first request after the one before has run out; its first request always starts. A key's
    requests are taken by time and number within a micro-batch, and batches as they come: a request older than those
    decided before counts at the time of the last of them, so none is dropped and no decision changes. State is one
    row a key and never runs out. A task holds a key's requests of one micro-batch at a time, which the size of the batch bounds.

    Nulls: a null key is a key; a null time counts as the last time seen. Rows that repeat are requests of their own.
    """
    window = round(seconds * 1_000_000)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    rows = requests.select(key, number, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))

    def settle(asked, now: tuple[int, int, int] | None):
        import pandas as pd

        asked, granted, wait = asked.sort_values(["_at", number], na_position="last"), [], []
        for t in asked["_at"].tolist():
            now, fine, left = decide(now, None if pd.isna(t) else int(t), limit, window)
            granted.append(fine)
            wait.append(left / 1e6)
        return pd.DataFrame({key: asked[key].to_numpy(), number: asked[number].to_numpy(), "granted": granted, "wait_s": wait}), now

    def run(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        found, now = settle(pd.concat(list(frames)), tuple(state.get) if state.exists else None)
        state.update(now)
        yield found

    out = f"{key} {kinds[key]}, {number} {kinds[number]}, granted boolean, wait_s double"
    if not requests.isStreaming:
        return rows.groupBy(key).applyInPandas(lambda asked: settle(asked, None)[0], out)
    return rows.groupBy(key).applyInPandasWithState(run, out, STATE, "append", "NoTimeout")


_LIMIT, _HOURS = 2, 36


@query("stream_limited_starts", f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, us AS start, 1 AS n, true AS granted, CAST(0 AS DOUBLE) AS wait_s FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.event_id, r.i, CASE WHEN r.us - f.start >= {_HOURS * 3_600_000_000} THEN r.us ELSE f.start END, CASE WHEN r.us - f.start >= {_HOURS * 3_600_000_000} THEN 1 WHEN n < {_LIMIT} THEN n + 1 ELSE n END,
  r.us - f.start >= {_HOURS * 3_600_000_000} OR n < {_LIMIT}, CASE WHEN r.us - f.start >= {_HOURS * 3_600_000_000} OR n < {_LIMIT} THEN 0 ELSE ({_HOURS * 3_600_000_000} - (r.us - f.start)) / 1e6 END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, event_id, granted, round(wait_s, 3) AS wait_s FROM f""")
def stream_limited_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two starts of a user in 36 hours. The SQL is that of a table in one micro-batch, or of files that come in order."""
    rows = arriving(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = run_batches(limited(rows, "user_id", "event_id", "ts", _LIMIT, _HOURS * 3600), shared_folder(spark), "append")
    return out.select("user_id", "event_id", "granted", F.round("wait_s", 3).alias("wait_s"))
