"""Nearest vectors by cosine: an index of cells around centroids, searched by probes or, with the cells' radii as bounds, exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import table

DIGITS = 9  # scores are rounded, so that equal ones stay equal
SLACK = 1e-9  # of distances, for sums in another order


def unit(vector: Column, size: int) -> Column:
    """The vector with length one as array<double>; null unless it has ``size`` finite components, not all zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    fine = (F.size(v) == size) & F.coalesce(norm > 0, F.lit(False)) & ~F.isnan(norm) & (norm != float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / norm))


def fit(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of the rows of ``x`` by Lloyd's rounds; fewer than ``cells`` if there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds if len(c) else 0):
        at = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0))


def _matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(column) else np.zeros((0, size))


class VectorIndex:
    """Every usable row of ``vectors`` (key, column) in the cell of its nearest centroid.

    Centroids are fitted on a bounded sample: ``sample`` rows by a hash of the key. ``rows`` (id, v, cell, part): a
    cell with more than ``most`` vectors is split in parts by a hash of the key, so that no cell, however full, is one
    task's. ``radius`` and ``parts`` are per cell; there are ``cells`` of them at most. Write ``rows`` as a table to search it often.
    """

    def __init__(self, vectors: DataFrame, size: int, cells: int = 64, sample: int = 20_000, most: int = 20_000, key: str = "vec_id", column: str = "embedding"):
        self.size = size
        rows = vectors.select(F.col(key).alias("id"), unit(F.col(column), size).alias("v")).where("v is not null")
        n = rows.count()
        picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1.0, 1.2 * sample / max(n, 1)) * 1_000_000)).select("v").limit(2 * sample)
        self.centroids = fit(_matrix(picked.toArrow()["v"], size), cells)
        centroids = self.centroids

        @F.pandas_udf("cell int, away double")
        def placed(v):
            import pandas as pd

            d = _distances(np.stack(v.to_list()) if len(v) else np.zeros((0, size)), centroids)
            at = d.argmin(axis=1)
            return pd.DataFrame({"cell": at, "away": d[np.arange(len(d)), at]})

        near = rows.select("id", "v", placed("v").alias("p")).select("id", "v", "p.cell", "p.away")
        each = {r.cell: r for r in near.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()} if len(centroids) else {}
        self.parts = np.array([-(-each[c].n // most) if c in each else 0 for c in range(len(centroids))], np.int64)
        self.radius = np.array([each[c].away if c in each else 0.0 for c in range(len(centroids))])
        parts = F.element_at(F.array(*[F.lit(max(int(p), 1)) for p in self.parts] or [F.lit(1)]), F.col("cell") + 1)
        self.rows = near.select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("part"))


def _visit(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the ``k`` best of each part of a cell that a query visits. ``asked``: query_id, q, cell, part."""
    size = index.size

    def best(left, right):
        import pyarrow as pa

        x, q = _matrix(right["v"], size), _matrix(left["q"], size)
        ids, queries = right["id"], left["query_id"]
        # in the order of ids, so that among equal scores a stable sort leaves the smaller id first
        order = np.array(ids.combine_chunks().argsort() if hasattr(ids, "argsort") else pa.compute.sort_indices(ids), np.int64)
        x = x[order]
        rows, cols, scores = [], [], []
        for at in range(0, len(q), 512):
            s = np.round(q[at : at + 512] @ x.T, DIGITS)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(at, at + len(s)), top.shape[1]))
            cols.append(top.ravel())
            scores.append(np.take_along_axis(s, top, axis=1).ravel())
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([queries.take(pa.array(join(rows, np.int64))), ids.take(pa.array(order[join(cols, np.int64)])), pa.array(join(scores, float))], names=["query_id", "id", "score"])

    kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(index.rows.dtypes)['id']}, score double"
    return asked.groupBy("cell", "part").cogroup(index.rows.groupBy("cell", "part")).applyInArrow(best, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most ``k`` rows from each part that a query visits: so is what a query has together here."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 44, exact: bool = False, threshold: float = -1.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each usable query the ``k`` indexed vectors of the highest cosine, at least ``threshold``; ties to the smaller id.

    A query visits the ``probes`` cells of the nearest centroids; vectors that lie in clusters need far fewer than those
    spread alike in all directions, for which the default is. With ``exact`` it then visits every further cell that
    can hold one of its ``k`` best: no vector of a cell is nearer than the query's distance from the centroid less the
    cell's radius. Both sides travel by cell; queries are as many rows as cells they visit, vectors one each.

    Null ids, repeated rows: kept like others. Queries with too few or unusable components have no rows; neither has an empty index.
    """
    centroids, parts, radius, size = index.centroids, index.parts, index.radius, index.size
    asked = queries.select(F.col(key).alias("query_id"), unit(F.col(column), size).alias("q")).where("q is not null")

    def cells(choose):
        @F.pandas_udf("array<struct<cell:int,part:int>>")
        def visited(q, bar):
            import pandas as pd

            d = _distances(np.stack(q.to_list()) if len(q) else np.zeros((0, size)), centroids)
            return pd.Series([[{"cell": int(c), "part": p} for c in cs for p in range(int(parts[c]))] for cs in choose(d, bar.to_numpy())])

        return lambda df: df.select("query_id", "q", F.explode(visited("q", "bar")).alias("at")).select("query_id", "q", "at.cell", "at.part")

    # cells without vectors are passed over
    order = lambda d: np.argsort(np.where(parts[None, :] > 0, d, np.inf), axis=1, kind="stable")
    first = cells(lambda d, _: [row[:probes] for row in order(d)])(asked.withColumn("bar", F.lit(0.0)))
    found = _visit(index, first, k)
    if exact:
        # the k-th score so far bounds the distance within which the result lies
        last = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bar"))
        within = asked.join(last.withColumnRenamed("query_id", "_id").distinct(), F.col("query_id").eqNullSafe(F.col("_id")), "left").select("query_id", "q", F.coalesce("bar", F.lit(2.0)).alias("bar"))
        rest = cells(lambda d, bar: [[c for c in row[probes:] if d[i, c] - radius[c] <= bar[i] + 1e-4 * (bar[i] < 1e-4) + SLACK] for i, row in enumerate(order(d))])(within)
        found = found.unionByName(_visit(index, rest, k))
    return _ranked(found.where(F.col("score") >= threshold), k)


def _size(vectors: DataFrame) -> int:
    """The most common number of components."""
    found = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


_SQL = f"""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.x, b.x) / a.n / b.n, {DIGITS}) AS score FROM u AS a, u AS b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


@query("nearest_vectors", _SQL)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(VectorIndex(vectors, _size(vectors)), vectors.where("vec_id % 20 = 0"), exact=True)


@query("probed_vectors")
def probed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by probes alone; tests hold its recall."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(VectorIndex(vectors, _size(vectors)), vectors.where("vec_id % 20 = 0"))
