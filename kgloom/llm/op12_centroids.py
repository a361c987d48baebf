"""Clustering of integer vectors around centroids, exact, with float32 matrix products to screen.

A vector's components become floor(SCALE * x). The first centroids are the K vectors of least hash. Each round every vector goes to its
nearest centroid and every centroid with vectors becomes their componentwise floor of the mean; then vectors are assigned once more.

A batch of vectors meets all centroids in one float32 product. The rounding error of such a product is at most gamma * |x| * |c|, in
whatever order it is summed (gamma from the number of components and the unit roundoff, two conversions included), so |c|^2 - 2 x.c lies in
a known interval. A centroid whose interval begins above the least upper end can't be the nearest; where more than one is left, their
distances are computed in exact integers, and the lowest number wins ties. Vectors or centroids too large for 64-bit squares go through Python's
integers whole.

No vector moves: a round sends K sums a task, and the driver holds K centroids. Sums and means are integers of any size up to 38 digits.

A vector is kept if it has DIM components, none null or not finite, and none beyond LIMIT once scaled (no distance to it would fit
64 bits). Fewer vectors than K give as many centroids. Repeated rows are vectors of their own, also as first centroids (equal hashes go by
their components); a null id hashes like the empty text. A distance or sum that doesn't fit 64 bits is null. An empty table gives an empty
result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, quoted, stage

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LIMIT = 10**18
#: Exact distances held at once, in components.
PAIRS = 1 << 21

Centroids = list[list[int]]


class Nearest:
    """Assigns blocks of integer vectors to the nearest of some centroids."""

    def __init__(self, centroids: Centroids) -> None:
        self.plain = np.array(centroids, dtype=object)
        self.k, self.dim = self.plain.shape
        self.safe = math.isqrt((2**63 - 1) // self.dim) // 2  # squares of differences of such numbers add up within 64 bits
        self.screens = max(abs(v) for c in centroids for v in c) <= self.safe
        if self.screens:
            self.exact = self.plain.astype(np.int64)
            self.single = self.exact.T.astype(np.float32)
            self.squares = (self.exact * self.exact).sum(axis=1).astype(np.float64)
            steps = (self.dim + 3) * 2.0**-24
            self.gamma = steps / (1 - steps)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """(cluster, distance, pairs computed exactly) of the rows of x, int64."""
        cluster, distance, pairs = np.empty(len(x), np.int32), [0] * len(x), 0
        large = np.abs(x).max(axis=1) > self.safe if self.screens else np.ones(len(x), bool)
        for i in np.flatnonzero(large):
            all_of = ((x[i].astype(object) - self.plain) ** 2).sum(axis=1).tolist()
            cluster[i], distance[i], pairs = all_of.index(min(all_of)), min(all_of), pairs + self.k
        rows, step = np.flatnonzero(~large), max(1, PAIRS // (self.k * self.dim))
        for at in range(0, len(rows), step):
            part = rows[at: at + step]
            cluster[part], n = self.screened(x[part])
            pairs += n
            for i, d in zip(part, ((x[part] - self.exact[cluster[part]]) ** 2).sum(axis=1).tolist(), strict=True):
                distance[i] = d
        return cluster, distance, pairs

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c for rows x and centroids c."""
        product = (x.astype(np.float32) @ self.single).astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        error = self.gamma * norms[:, None] * np.sqrt(self.squares)[None, :]
        middle = self.squares[None, :] - 2 * product
        radius = (2 * error + 2.0**-50 * (self.squares[None, :] + 2 * np.abs(product))) * (1 + 2.0**-40)  # the rest: rounding of these lines in double
        return middle - radius, middle + radius

    def screened(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        lower, upper = self.bounds(x)
        near = lower <= upper.min(axis=1)[:, None]
        cluster = near.argmax(axis=1).astype(np.int32)
        open_ = np.flatnonzero(near.sum(axis=1) > 1)
        i, j = np.nonzero(near[open_])
        full = np.full((len(open_), self.k), np.iinfo(np.int64).max)
        full[i, j] = ((x[open_[i]] - self.exact[j]) ** 2).sum(axis=1)
        cluster[open_] = full.argmin(axis=1)
        return cluster, len(i)


def kept(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, components as doubles."""
    v = F.transform(quoted(embedding), lambda x: x.cast("double"))
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LIMIT / scale), F.lit(False)))
    return df.select(quoted(vec_id).alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & fits)


def scaled(column, dim: int, scale: int) -> np.ndarray:
    """Rows of integers from an Arrow list column."""
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int64)


def first(vectors: DataFrame, k: int, scale: int) -> Centroids:
    named = vectors.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    least = named.orderBy("h", "v").limit(k).agg(F.sort_array(F.collect_list(F.struct("h", "v"))).alias("rows"))  # merged on an executor: k rows reach the driver
    return [[math.floor(scale * x) for x in r["v"]] for r in least.first()["rows"]]


def moved(vectors: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """The centroids after a round; of the vectors only sums by task and cluster travel."""
    dim = len(centroids[0])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        near, total, count = Nearest(centroids), np.zeros((len(centroids), dim), dtype=object), [0] * len(centroids)
        for batch in batches:
            x = scaled(batch.column("v"), dim, scale)
            cluster, _, _ = near(x)
            small = not len(x) or np.abs(x).max() < 2**40
            for j in np.unique(cluster).tolist():
                own = x[cluster == j]
                total[j] += (own if small else own.astype(object)).sum(axis=0).astype(object)
                count[j] += len(own)
        some = [j for j, n in enumerate(count) if n]
        sums = [[Decimal(int(v)) for v in total[j]] for j in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[j] for j in some], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])
        give_back()

    parts = vectors.select("v").mapInArrow(add, "cluster int, n bigint, sums array<decimal(38,0)>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # a row for each component of a centroid
        out[r["cluster"]][r["i"]] = int(r["s"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = len(centroids[0])

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        near = Nearest(centroids)
        for batch in batches:
            cluster, distance, _ = near(scaled(batch.column("v"), dim, scale))
            fitting = [d if d < 2**63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(fitting, pa.int64())], names=["vec_id", "cluster", "distance"])
        give_back()

    return vectors.mapInArrow(find, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance bigint")


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, Centroids]:
    """((vec_id, cluster, distance), centroids) after `rounds` rounds."""
    vectors = kept(df, vec_id, embedding, dim, scale)
    centroids = first(vectors, k, scale)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return stage(assigned(vectors, centroids, scale)), centroids


def with_inertia(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """rows with cluster_inertia, inertia and centroid_sha256, for which one row a cluster goes to the driver and back."""
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    total = None if None in sums.values() else sum(map(int, sums.values()))
    fit = lambda x: None if x is None or x >= 2**63 else int(x)
    about = [(j, fit(sums.get(j, 0)), fit(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def _sql() -> str:
    square = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(k.v) AS v, min({{'d': {square}, 'c': c.cluster}}) AS best FROM kept k, c{r} c GROUP BY vec_id)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
                FROM (SELECT best.c AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY ALL) GROUP BY cluster)""")
            steps.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
      c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v FROM kept QUALIFY cluster < {K}),
      {', '.join(steps)}
      SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.c"""


SQL = _sql()
