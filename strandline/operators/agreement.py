"""Agreement of two readers by slot, with a composite over whole frames and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.readers import band
from strandline.operators.summaries import BLANK, kappa
from strandline.registry import query
from strandline.sources.tables import table

#: The slots in the order of the table, and the names a track judgment goes by.
SLOTS = ("finding_type", "anatomy", "laterality", "assertion", "temporal_change", "measurement")
TRACK_KEYS = ("track_link", "linked", "same_track", "belongs_to_same_track", "decision")
COMPOSITE = "full_frame (all slots)"


def slot_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(slot, a, b) for the items (item, labels map<string,string>) of both readers: a row per slot that both maps hold, and one of the composite.

    The composite joins the canonical slots that occur at all, if more than one does, where both readers hold every one.
    """
    both = left.select("item", F.col("labels").alias("la")).join(right.select("item", F.col("labels").alias("lb")), "item")
    common = F.array_intersect(F.map_keys("la"), F.map_keys("lb"))
    each = both.select(F.explode(common).alias("slot"), "la", "lb").select("slot", F.col("la")[F.col("slot")].alias("a"), F.col("lb")[F.col("slot")].alias("b"))
    held = both.select(F.explode(F.array_union(F.map_keys(F.coalesce("la", F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce("lb", F.create_map().cast("map<string,string>"))))).alias("slot")).distinct()
    present = {r.slot for r in held.where(F.col("slot").isin(*SLOTS)).collect()}  # six at most
    frame = [s for s in SLOTS if s in present]
    if len(frame) < 2:
        return each
    whole = lambda m: F.concat_ws("\x1f", *[F.coalesce(F.col(m)[s], F.lit(BLANK)) for s in frame])
    full = [F.map_contains_key(m, s) for m in ("la", "lb") for s in frame]
    every = full[0]
    for c in full[1:]:
        every = every & c
    return each.union(both.where(every).select(F.lit(COMPOSITE).alias("slot"), whole("la").alias("a"), whole("lb").alias("b")))


def bootstrap_intervals(pairs: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(slot, low, high): percentile intervals of kappa over resampled items.

    To draw n items with replacement is to draw how many fall on each pair of categories, so items are counted by pair
    first and each resample is one multinomial draw over the table of counts: a slot's group is its table, however many
    items there are. Resamples without a kappa are left out; without any the interval is null.
    """
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(BLANK))
    cells = pairs.groupBy("slot", c("a").alias("a"), c("b").alias("b")).agg(F.count("*").alias("n"))

    def interval(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["a", "b"])
        names = sorted(set(t.a) | set(t.b))
        a, b, n = t.a.map(names.index).to_numpy(), t.b.map(names.index).to_numpy(), t.n.to_numpy()
        rng, k, found = np.random.default_rng(seed), len(names), []
        for at in range(0, n_boot, 200):
            draws = rng.multinomial(n.sum(), n / n.sum(), size=min(200, n_boot - at)) / n.sum()
            rows, columns = (np.stack([np.bincount(x, d, k) for d in draws]) for x in (a, b))
            po, pe = draws[:, a == b].sum(axis=1), (rows * columns).sum(axis=1)
            ok = 1 - pe > 1e-12
            found.append((po[ok] - pe[ok]) / (1 - pe[ok]))
        kappas = np.concatenate(found)
        low, high = np.percentile(kappas, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if len(kappas) else (None, None)
        return pd.DataFrame({"slot": [t.slot.iloc[0]], "low": [low], "high": [high]})

    return cells.groupBy("slot").applyInPandas(interval, "slot string, low double, high double")


def scored_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Kappa and band per slot of two readers; ``place`` orders canonical slots, then track judgments, then others by name, then the composite."""
    known = {s: i for i, s in enumerate((*SLOTS, *TRACK_KEYS))} | {COMPOSITE: 1000}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("slot")), F.lit(100))
    return kappa(slot_pairs(left, right), "a", "b", ("slot",)).select("slot", place.alias("place"), "n_items", "po", "pe", "kappa", F.coalesce(band(F.col("kappa")), F.lit("n/a")).alias("band"))


def _readers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = F.substring("o_orderpriority", 1, 1)
    a = o.where(k % 9 != 0).select(k.alias("item"), F.create_map(F.lit("anatomy"), first, F.lit("assertion"), F.col("o_orderstatus"), F.lit("linked"), (k % 2).cast("string")).alias("labels"))
    b = o.where(k % 10 != 0).select(k.alias("item"), F.map_filter(F.create_map(F.lit("anatomy"), F.when(k % 7 == 0, "1").when(k % 8 != 0, first), F.lit("assertion"), F.when(k % 4 == 0, "F").otherwise(F.col("o_orderstatus")), F.lit("linked"), (k % 3 % 2).cast("string")), lambda s, _: (s != "linked") | (k % 5 != 0)).alias("labels"))
    return a, b


_PAIRS = """j AS (SELECT o_orderkey AS k, substr(o_orderpriority, 1, 1) AS a1, CASE WHEN o_orderkey % 7 = 0 THEN '1' WHEN o_orderkey % 8 <> 0 THEN substr(o_orderpriority, 1, 1) END AS b1,
  o_orderstatus AS a2, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS b2, CAST(o_orderkey % 2 AS VARCHAR) AS a3, CAST(o_orderkey % 3 % 2 AS VARCHAR) AS b3 FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0),
p AS (SELECT 'anatomy' AS slot, 1 AS place, a1 AS a, coalesce(b1, '∅null') AS b FROM j UNION ALL SELECT 'assertion', 3, a2, b2 FROM j UNION ALL SELECT 'linked', 7, a3, b3 FROM j WHERE k % 5 <> 0
  UNION ALL SELECT 'full_frame (all slots)', 1000, a1 || chr(31) || a2, coalesce(b1, '∅null') || chr(31) || b2 FROM j)"""


@query("scored_slots", f"""WITH {_PAIRS}, c AS (SELECT slot, place, a, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT slot, place, sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c GROUP BY ALL),
e AS (SELECT x.slot, sum(x.n * y.n) AS chance FROM (SELECT slot, a, sum(n) AS n FROM c GROUP BY ALL) x JOIN (SELECT slot, b, sum(n) AS n FROM c GROUP BY ALL) y ON x.slot = y.slot AND a = b GROUP BY x.slot),
s AS (SELECT slot, place, CAST(n AS BIGINT) AS n_items, same / n AS po, coalesce(chance, 0) / (n * n) AS pe FROM t LEFT JOIN e USING (slot)),
k AS (SELECT slot, place, n_items, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN 1 - pe > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM s)
SELECT *, CASE WHEN kappa IS NULL THEN 'n/a' WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def scored_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pair(*_readers(spark, sf_dir))


@query("kappa_intervals")
def kappa_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws have no form in SQL."""
    return bootstrap_intervals(slot_pairs(*_readers(spark, sf_dir)))
