"""Exact k-means on integer vectors: float32 screening with rigorous rounding-error intervals.

A float32 matrix product gives every centroid's score |c|^2 - 2 x.c of a whole batch at once. How far rounding can have moved a score
is bounded from the norms, so each score is an interval; centroids whose interval lies above the end of another's cannot be nearest.
Rows with one centroid left are settled; for the others the squared distances to those that are left are computed in integers, the
smallest number winning a tie. Sums and distances are integers throughout, so that the result is the same however rows are dealt out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Integer components stay below this, so that no product or sum of a vector leaves 64 bits (up to 64 dimensions).
LARGEST = 1 << 27
_UNIT32, _UNIT64 = 2.0**-24, 2.0**-53


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids) booleans: centroids that may be the nearest of a row of integers, the nearest always among them."""
    dims = x.shape[1]
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    # a sum of n products in any order is off by at most n u / (1 - n u) of the sum of their sizes, and each factor was rounded
    # once; that sum is at most the product of the norms
    terms = dims + 3
    gamma = terms * _UNIT32 / (1 - terms * _UNIT32)
    norm = lambda a: np.nextafter(np.sqrt((a * a).sum(axis=1).astype(np.float64)) * (1 + 4 * _UNIT64), np.inf)
    sizes = norm(x)[:, None] * norm(centroids)[None, :]
    squares = (centroids * centroids).sum(axis=1).astype(np.float64)[None, :]
    score = squares - 2 * product
    # the last term covers the float64 steps here
    off = 2 * gamma * sizes * (1 + 8 * _UNIT64) + 16 * _UNIT64 * (squares + 2 * np.abs(product) + sizes)
    return score - off <= (score + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row of integers, the smallest number in a tie, and how many rows were decided in integers."""
    left = shortlist(x, centroids)
    out = left.argmax(axis=1)
    rows = np.flatnonzero(left.sum(axis=1) > 1)
    if len(rows):
        r, c = np.nonzero(left[rows])
        away = x[rows[r]] - centroids[c]
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        exact[r, c] = (away * away).sum(axis=1)
        out[rows] = exact.argmin(axis=1)
    return out, len(rows)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def integer_vectors(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows with exactly `dims` components, none null or non-finite; v holds floor(scale * component)."""
    x = F.col("x")
    scaled = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))))
    fits = F.forall(x, lambda e: F.abs(e) < LARGEST / scale)
    refuse = F.raise_error(F.lit(f"a component of {LARGEST // scale:,} or more: squared distances would not fit 64 bits"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    whole = rows.where((F.size("x") == dims) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return whole.select("vec_id", F.when(fits, scaled).otherwise(refuse).cast("array<int>").alias("v"))


def _first(points: DataFrame, k: int, seed: int) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _sums(points: DataFrame, centroids: np.ndarray, dims: int) -> list:
    """One row a centroid that has vectors: n and the sums of their components. Each task adds up its own first."""

    def start():
        def each(batch: pa.RecordBatch):
            x = _matrix(batch.column("v"), dims)
            mine, _ = nearest(x, centroids)
            found = np.unique(mine)
            sums = np.stack([x[mine == c].sum(axis=0) for c in found]) if len(found) else np.empty((0, dims), np.int64)
            return {"cluster": found, "n": np.bincount(mine, minlength=len(centroids))[found], "s": pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), dims).cast(pa.list_(pa.int64()))}

        return each

    partial = map_batches(points.select("v"), "cluster int, n long, s array<long>", start)
    total = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("s")).collect()


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids as integers.

    Centroids begin as the k vectors with the smallest sha256 of seed:vec_id, equal ones in the order of their components; each round
    assigns all vectors and replaces each centroid that has vectors by floor(sum / count) of each component. What reaches the driver a
    round is one row a centroid. Rows with null vectors, null or non-finite components or another number of them are left out; a null
    id hashes as an empty one; repeated rows each count; ties go to the smaller number; with fewer than k vectors there are
    as many centroids; an empty table gives no rows; other columns are ignored. Components of 131,072 or more are refused.
    """
    points = stage(integer_vectors(vectors, dims, scale, id_col, vector_col), "integer-vectors")
    centroids = _first(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        after = centroids.copy()
        for r in _sums(points, centroids, dims):
            after[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
        if (after == centroids).all():
            break  # all later rounds would give the same
        centroids = after

    def start():
        def each(batch: pa.RecordBatch):
            x = _matrix(batch.column("v"), dims)
            mine, _ = nearest(x, centroids)
            away = x - centroids[mine]
            return {"vec_id": batch.column("vec_id"), "cluster": mine, "distance": (away * away).sum(axis=1)}

        return each

    return map_batches(points, "vec_id long, cluster int, distance long", start), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia and inertia (null beyond a long) and the sha256 of each row's centroid."""
    spark = assigned.sparkSession
    assigned = stage(assigned, "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    named = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, fits(sums.get(i, 0)), fits(sum(sums.values())), named(c)) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_interval_kmeans(spark, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """Rounds one after the other; list_inner_product on doubles is exact for integers of this size."""
    parts = [
        """p AS MATERIALIZED (
  SELECT vec_id, v FROM (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)
)""",
        """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM p ORDER BY h, v LIMIT 8)
)""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, n, min(v) AS v, min({{'d': d, 'cluster': cluster}}) AS best FROM (
    SELECT vec_id, n, v, cluster, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d
    FROM (SELECT *, row_number() OVER () AS n FROM p) CROSS JOIN c{i}) GROUP BY vec_id, n
)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY dim) AS c FROM (
      SELECT best.cluster AS cluster, dim, floor(sum(v[dim]) / count(*)) AS mean FROM a{i}, range(1, 65) AS r(dim) GROUP BY 1, 2) GROUP BY 1) m USING (cluster)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM (SELECT vec_id, best.cluster AS cluster, CAST(best.d AS BIGINT) AS distance FROM a{ROUNDS}) JOIN c{ROUNDS} USING (cluster)
"""  # fmt: skip


OP11_SQL = _sql()
