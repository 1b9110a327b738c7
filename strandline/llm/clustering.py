"""Clusters of vectors around centroids, in whole numbers: distances by GEMM where doubles are exact, sums by treeAggregate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import new_folder, other_columns, remove_folder, table

SEED = 3
EXACT = 1 << 53  # whole numbers below are exact in doubles
WIDE = 1 << 62  # and below this in 64 bits, with room for one more sum
ROWS, CENTRES = 4096, 1024  # a block's bounds


def whole(vectors, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of floor(scale * x), whether the vector is kept) of an Arrow column of lists of doubles.

    floor(scale * x) of a double is again a double, as the scale is a power of two, so the matrix is exact at any magnitude.
    """
    import pyarrow.compute as pc

    kept = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False).astype(bool)
    rows = vectors.filter(kept).flatten()
    rows = pc.cast(rows, "float64").to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.floor(scale * rows)
    good = np.isfinite(rows).all(axis=1)
    kept[np.flatnonzero(kept)[~good]] = False
    return rows[good], kept


def _integers(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole, as Python's integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class Centres:
    """Centroids with whole components of any size, and the nearest of them for blocks of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.most = np.array([float(max(map(abs, c), default=0)) for c in centroids])
        self.doubles = np.array([[float(v) for v in c] for c in centroids])
        self.norms = (self.doubles**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(number of the nearest centroid, squared distance) of each row; of equal ones the smallest number.

        All terms of |x|^2 - 2 x.c + |c|^2, and all sums of some of them, are at most size * (max|x| + max|c|)^2:
        below 2^53 the doubles of a product of matrices are exact in any order. Rows beyond are worked out in integers.
        """
        n, size = x.shape
        reach = np.abs(x).max(axis=1, initial=0) + self.most.max(initial=0)
        safe = size * reach * reach < EXACT
        best, far = np.zeros(n, np.int64), np.full(n, np.inf)
        some = x if safe.all() else x[safe]
        own = (some * some).sum(axis=1)
        at, low = np.zeros(len(some), np.int64), np.full(len(some), np.inf)
        for start in range(0, len(self.centroids), CENTRES):
            c = self.doubles[start : start + CENTRES]
            d = own[:, None] - 2.0 * (some @ c.T) + self.norms[None, start : start + CENTRES]
            k = d.argmin(axis=1)
            least = d[np.arange(len(some)), k]
            better = least < low
            at[better], low[better] = k[better] + start, least[better]
        best[safe], far[safe] = at, low
        distance = [int(v) if ok else 0 for v, ok in zip(far.tolist(), safe.tolist(), strict=True)]
        for i, row in zip(np.flatnonzero(~safe).tolist(), _integers(x[~safe]).tolist(), strict=True):
            each = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in self.centroids]
            best[i] = each.index(min(each))
            distance[i] = each[best[i]]
        return best, distance


class Sums:
    """Per centroid: the sum of its vectors, their number, and of their squared distances. Exact: 64 bits while they hold it, integers after."""

    def __init__(self, k: int, size: int):
        self.sums, self.bound = np.zeros((k, size), np.int64), 0
        self.counts, self.inertia = [0] * k, [0] * k

    def _room(self, more: int) -> None:
        self.bound += more
        if self.bound >= WIDE and self.sums.dtype != object:
            self.sums = self.sums.astype(object)

    def add(self, x: np.ndarray, best: np.ndarray, distance: list[int]) -> Sums:
        most = int(np.abs(x).max(initial=0))
        self._room(most * len(x))
        k = len(self.counts)
        if most * len(x) < EXACT:  # a product with the memberships sums all centroids at once
            for start in range(0, k, CENTRES):
                member = (best[None, :] == np.arange(start, min(k, start + CENTRES))[:, None]).astype(np.float64)
                self.sums[start : start + CENTRES] += (member @ x).astype(np.int64)
        else:
            for i, row in zip(best.tolist(), _integers(x), strict=True):
                self.sums[i] = [a + b for a, b in zip(self.sums[i].tolist(), row.tolist(), strict=True)]
        for i, n in enumerate(np.bincount(best, minlength=k).tolist()):
            self.counts[i] += n
        for i, d in zip(best.tolist(), distance, strict=True):
            self.inertia[i] += d
        return self

    def merge(self, other: Sums) -> Sums:
        self._room(other.bound)
        self.sums = self.sums + other.sums
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia, strict=True)]
        return self


def _blocks(vectors: DataFrame, column: str, size: int, scale: int) -> DataFrame:
    """Rows (block, kind): up to ROWS kept vectors in one binary value, in the smallest of three kinds of numbers that holds them."""

    def pack(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, _ = whole(batch[0], size, scale)
            parts = [x[i : i + ROWS] for i in range(0, len(x), ROWS)]
            most = [np.abs(p).max(initial=0) for p in parts]
            kinds = ["<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<f8" for m in most]
            packed = [p.astype(kind).tobytes() for p, kind in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(kinds, pa.string())], ["block", "kind"])

    return vectors.select(F.col(column).cast("array<double>")).mapInArrow(pack, "block binary, kind string")


def _sum_up(blocks, centroids: list[list[int]]) -> Sums:
    """One pass over the blocks: sums, numbers and squared distances by the nearest centroid."""
    k, size = len(centroids), len(centroids[0])
    centres = blocks.context.broadcast(Centres(centroids))  # bounded: centroids by components

    def step(acc: Sums, row) -> Sums:
        x = np.frombuffer(row.block, row.kind).astype(np.float64).reshape(-1, size)
        return acc.add(x, *centres.value.nearest(x))

    try:
        return blocks.treeAggregate(Sums(k, size), step, Sums.merge)
    finally:
        centres.unpersist()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = SEED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The kept rows of ``vectors`` with a struct column ``_cluster`` (cluster, distance, cluster_inertia, inertia, centroid).

    Kept are vectors with exactly ``size`` components, none null or non-finite; a component x counts as
    floor(scale * x), with ``scale`` a power of two (one that overflows a double is non-finite). The first centroids
    are the ``k`` vectors with the smallest SHA-256 of ``seed:key``. A round assigns each vector to the nearest
    centroid (of equal ones to the smaller number), then moves each that has vectors to the componentwise
    floor(sum / count); empty ones stay. Rounds end early only when no centroid moves: all later ones would repeat it.

    Vectors are written once in blocks; a round is one ``treeAggregate`` over them that carries ``k`` sums, whatever
    the number of vectors. All figures are exact integers at any magnitude (see ``Centres.nearest``). Blocks lie in the shared
    folder, so a lost executor costs a reread, and go before the result is read.

    Nulls: a null key hashes as an empty string. Repeated rows, and others of equal hash, go by their components in the
    order of first centroids. With fewer than ``k`` kept vectors there are fewer centroids; with none, or an empty table, no rows.
    Numbers beyond 64 bits are null. A column ``_cluster`` of the input, in any case, is replaced.
    """
    spark = vectors.sparkSession
    own = other_columns(vectors, "_cluster")
    out = T.StructType([*[vectors.schema[c] for c in own], T.StructField("_cluster", T._parse_datatype_string("struct<cluster:int,distance:bigint,cluster_inertia:bigint,inertia:bigint,centroid:array<string>>"))])
    path = new_folder(spark, "vectors")
    try:
        _blocks(vectors, column, size, scale).write.parquet(path)
        values = F.col(column).cast("array<double>")
        scaled = F.transform(values, lambda x: x * scale)
        finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
        first = vectors.where((F.size(values) == size) & finite).select(hashed.alias("h"), scaled.alias("v"))
        centroids = [[int(np.floor(x)) for x in r.v] for r in first.orderBy("h", "v").limit(k).collect()]  # ``k`` rows
        if not centroids:
            return spark.createDataFrame([], out)
        blocks = spark.read.schema("block binary, kind string").parquet(path).rdd
        for _ in range(rounds):
            found = _sum_up(blocks, centroids)
            moved = [[s // n for s in sums] if n else c for sums, n, c in zip(found.sums.tolist(), found.counts, centroids, strict=True)]
            if moved == centroids:
                break
            centroids = moved
        inertia = _sum_up(blocks, centroids).inertia
    finally:
        remove_folder(spark, path)

    def fits(v: int) -> int | None:
        return v if -(1 << 63) <= v < 1 << 63 else None

    centres, texts = spark.sparkContext.broadcast(Centres(centroids)), [[str(v) for v in c] for c in centroids]
    each, total = [fits(v) for v in inertia], fits(sum(inertia))

    def assign(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
        for batch in batches:
            x, kept = whole(batch["_cl_values"], size, scale)
            rows = batch.filter(pa.array(kept))
            for at in range(0, len(x), ROWS):
                best, distance = centres.value.nearest(x[at : at + ROWS])
                best = best.tolist()
                values = (best, [fits(d) for d in distance], [each[b] for b in best], [total] * len(best), [texts[b] for b in best])
                struct = pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], names=names)
                part = rows.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in own], struct], [*own, "_cluster"])

    return vectors.select(*own, F.col(column).cast("array<double>").alias("_cl_values")).mapInArrow(assign, out)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "_cluster.cluster", "_cluster.distance", "_cluster.cluster_inertia", "_cluster.inertia", F.sha2(F.array_join("_cluster.centroid", ","), 256).alias("centroid_sha256"))


_NEAREST = "SELECT v.row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.row, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, {c} AS c) AS v GROUP BY v.row"
_ROUND = """
c{n} AS MATERIALIZED (
  WITH a AS ({nearest}),
  s AS (SELECT k, i, floor_div(sum(x[i]), count(*)) AS m FROM a JOIN v USING (row), range(1, 65) AS r(i) GROUP BY k, i),
  m AS (SELECT k, list(m ORDER BY i) AS x FROM s GROUP BY k)
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{p} AS c LEFT JOIN m USING (k)),"""
OP12_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT 8)),"""
    + "".join(_ROUND.format(n=n, p=n - 1, nearest=_NEAREST.format(c=f"c{n - 1}")) for n in range(1, 11)).replace("floor_div(sum(x[i]), count(*))", "((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    + f"""
a AS ({_NEAREST.format(c="c10")})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a JOIN v USING (row) JOIN c10 USING (k)
"""
)
