"""Centroid clustering: sort-means, in whole numbers.

Vectors become whole numbers, floor(scale * x), so every distance, sum and tie
is exact. A round orders, for each centroid, the others by their distance from
it (a table of k rows, made once a round). Each vector scans from the centroid
it had before: in that order, until one is strictly beyond twice the vector's
distance to its old centroid; none after it can be as near, by the triangle
inequality. On squares: stop where D2(old, other) > 4 * d2(vector, old).

The vectors stay where they are: a round is one pass over the staged table
(id, whole numbers, cluster), which is written again with its new clusters,
and a sum by cluster that is combined before its k rows a task are shuffled.
Only the centroids (k rows, at most ``MOST_NUMBERS`` numbers, checked) reach
the driver and go out to tasks. A staged round outlives any executor; the round
before it is removed.

Defined results: vectors of another length, with a null or a non-finite
component, or null are left out; a component beyond ``largest(dim)`` (after
scaling) raises an error, as squares would not fit 64 bits; fewer vectors than
k give as many centroids as vectors; equal vectors may be several centroids,
of which the least number wins; an empty cluster keeps its centroid; repeated
rows count each; an empty table gives an empty result. Of other columns only
``id`` is carried, so names cannot clash. A null id hashes as the empty text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import stage, unstage

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Of all centroids together, which every task holds.
MOST_NUMBERS = 1 << 20
#: Vectors handled together in a task.
BATCH = 8192


def largest(dim: int) -> int:
    """The bound of scaled components: four times a squared distance fits 62 bits."""
    return math.isqrt((1 << 60) // dim) // 2


def whole(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that count, as arrays of whole numbers."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = df.select(F.col(id).alias("id"), x.alias("x")).where((F.size("x") == dim) & ~F.exists("x", bad))
    scaled = F.transform("x", lambda c: F.when(F.abs(c * scale) < largest(dim), F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {largest(dim)} after scaling")).cast("long")))
    return kept.select("id", scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``seed:id``, in that order; ties by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def _squared(d: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid: the others by distance from it (then number), and these squared distances in that order."""
    k = len(centroids)
    order, far = np.empty((k, k), dtype=np.int64), np.empty((k, k), dtype=np.int64)
    for i in range(k):
        d = _squared(centroids - centroids[i])
        d[i] = -1  # itself first
        order[i] = np.lexsort((np.arange(k), d))
        far[i] = d[order[i]]
    return order[:, 1:], far[:, 1:]


def nearest(x: np.ndarray, old: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of vectors that had ``old``; ties to the lesser number."""
    d_old = _squared(x - centroids[old])
    best, least = old.copy(), d_old.copy()
    by = np.argsort(old, kind="stable")
    edges = np.searchsorted(old[by], np.arange(len(centroids) + 1))
    for c in range(len(centroids)):
        own = by[edges[c] : edges[c + 1]]
        # the farther a vector is from its old centroid, the longer it scans
        own = own[np.argsort(-d_old[own], kind="stable")]
        reach = -4 * d_old[own]
        for other, d2 in zip(order[c].tolist(), far[c].tolist(), strict=True):
            n = int(np.searchsorted(reach, -d2, "right"))  # those with d2 <= 4 * d_old
            if not n:
                break
            at = own[:n]
            d = _squared(x[at] - centroids[other])
            better = (d < least[at]) | ((d == least[at]) & (other < best[at]))
            at = at[better]
            best[at], least[at] = other, d[better]
    return best, least


def assigned(vectors: DataFrame, centroids: np.ndarray, keep: bool) -> DataFrame:
    """(id, v if ``keep``, cluster, distance) from (id, v, cluster)."""
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, *neighbours(centroids)))  # at most MOST_NUMBERS numbers and k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order, far = sent.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH):
                batch = whole_batch.slice(at, BATCH)
                v = batch.column(1)
                x = v.flatten().to_numpy().reshape(len(v), centroids.shape[1])
                best, least = nearest(x, batch.column(2).to_numpy().astype(np.int64), centroids, order, far)
                new = [pa.array(best.astype(np.int32)), pa.array(least)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *([v] if keep else []), *new], names=["id", *(["v"] if keep else []), "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v", "cluster").mapInArrow(run, f"id {kind}, {'v array<bigint>, ' if keep else ''}cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid at floor(sum / count) of its vectors."""
    dim = centroids.shape[1]
    sums = vectors.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in sums.collect():  # a row a centroid
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return out


def clustered(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector that counts, staged; the final centroids)."""
    if k * max(dim, k) > MOST_NUMBERS:
        raise ValueError(f"k * max(dim, k) is over {MOST_NUMBERS}")
    now = stage(whole(df, id, vector, dim, scale).withColumn("cluster", F.lit(0)), "vectors", free=False)
    centroids = first_centroids(now, k, seed)
    if not len(centroids):
        return now.select("id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        last, now = now, stage(assigned(now, centroids, keep=True).drop("distance"), "vectors", free=False)
        unstage(last)
        centroids = moved(now, centroids)
    return stage(assigned(now, centroids, keep=False), "clusters", free=False), centroids


def report(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with the inertia of their cluster and of all, and the hash of their centroid."""
    spark = rows.sparkSession
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a centroid
    marks = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")  # k rows


def query(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return report(rows, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    out = [
        f"""WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS mark
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row_number() OVER (ORDER BY mark, v) - 1 AS i, * FROM kept),
x AS (SELECT i, unnest(range({DIM})) AS d, unnest(v) AS x FROM p),
c0 AS (SELECT i AS c, d, x AS y FROM x WHERE i < {K})"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS (
  SELECT i, unnest(min({{'distance': s, 'c': c}})) FROM (SELECT i, c, sum((x - y) * (x - y))::BIGINT AS s FROM x JOIN c{r} USING (d) GROUP BY i, c) GROUP BY i)""")
        if r < ROUNDS:
            out.append(f"""m{r} AS (SELECT c, d, sum(x)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN x USING (i) GROUP BY c, d),
c{r + 1} AS (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS y FROM c{r} LEFT JOIN m{r} USING (c, d))""")
    out.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return (
        ",\n".join(out)
        + f"""
SELECT vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN p USING (i) JOIN h USING (c)"""
    )


ORACLE_SQL = _sql()
