"""Centroid clustering with block-norm screening.

Each vector is stored with the norms of its segments. By Cauchy and Schwarz, |x - c|^2 is at least the sum over segments of (|x_s| - |c_s|)^2, so these few
numbers of vector and centroid bound the distance from below. A centroid whose bound exceeds a distance already found is dropped; all others get the exact
distance in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.topk import usable
from verdigraph.plans.lineage import cut

#: Components up to this size have squared distances that fit a long, for up to 64 of them.
MOST = 1 << 27
#: Pairs of vector and centroid whose distances are taken at once.
PAIRS = 1 << 15


def segment_norms(whole: np.ndarray, segments: int) -> np.ndarray:
    """The Euclidean norms of ``segments`` equal parts of each row."""
    return np.sqrt((whole.astype(np.float64).reshape(len(whole), segments, -1) ** 2).sum(2))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        out[i : i + PAIRS] = ((a[i : i + PAIRS] - b[i : i + PAIRS]) ** 2).sum(1)
    return out


def nearest(whole: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of 64-bit integers the nearest centroid (the first of equal ones) and its squared distance; and how many distances were computed."""
    own = segment_norms(centroids, norms.shape[1])
    bound = ((norms[:, None] - own[None]) ** 2).sum(2)
    # Roundings stay far below this; a bound must not exceed the true distance.
    bound -= 1e-9 * ((norms**2).sum(1)[:, None] + (own**2).sum(1)) + 1e-6
    order = np.argsort(bound, axis=1, kind="stable")
    best = order[:, 0].copy()
    least = _distance(whole, centroids[best])
    computed = len(whole)
    live = np.arange(len(whole))
    for place in range(1, len(centroids)):
        # Bounds rise from place to place, so a row that is done here is done.
        live = live[bound[live, order[live, place]] <= least[live]]
        if not len(live):
            break
        other = order[live, place]
        d = _distance(whole[live], centroids[other])
        computed += len(live)
        better = (d < least[live]) | ((d == least[live]) & (other < best[live]))
        best[live[better]], least[live[better]] = other[better], d[better]
    return best, least, computed


def _stacked(batch: pd.DataFrame, segments: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.stack(batch.whole.to_list()).astype(np.int64)
    return whole, np.stack(batch.norms.to_list()).astype(np.float64).reshape(-1, segments)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, segments: int = 8, seed: int = 2, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector of ``vectors(vec_id, embedding)`` that is kept.

    Vectors with exactly ``dims`` components, none null or not finite, are kept, and components x count as floor(256 x). The first centroids are the ``k`` kept
    vectors (all, if fewer) with the least sha256 of ``seed:vec_id``; equal ones go by their components, and a null vec_id comes last. Each round assigns all
    vectors and moves every centroid with vectors to the floor of their mean; then vectors are assigned once more. Ties go to the smaller number.
    ``distance`` is squared, ``cluster_inertia`` and ``inertia`` its sums over the cluster and over all, ``centroid_sha256`` the digest of the centroid's
    components joined by commas. Repeated rows are vectors like others. Without kept vectors the result is empty. Other columns aren't read, whatever their names.
    A component x with |256 x| above 2**27 is an error, as distances might not fit a long.

    A round is one scan of the stored vectors: each task adds up its own clusters, so only ``k`` partial sums a task are shuffled and ``k`` centroids come back.
    """
    if dims % segments:
        raise ValueError("segments must divide dims")
    v = F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    large = F.exists("v", lambda x: F.abs(x.cast("double")) > MOST / 256)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).filter((F.size("v") == dims) & usable(F.col("v")))
    whole = F.when(large, F.raise_error(F.lit(f"a component is beyond {MOST} / 256"))).otherwise(v)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(norms=list(segment_norms(np.stack(batch.whole.to_list()), segments)) if len(batch) else [])

    # Ids go through Python without nulls, which would make numbers of 53 bits of them.
    ids = [F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("none")]
    stored = cut(kept.select(*ids, whole.alias("whole")).mapInPandas(pack, "id long, none boolean, whole array<long>, norms array<double>"), "cluster-vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.when(~F.col("none"), F.col("id").cast("string"))), 256)
    start = stored.select("whole", first.alias("h")).orderBy(F.asc_nulls_last("h"), "whole").limit(k)
    centroids = np.array([r.whole for r in start.collect()], np.int64)

    def assigned(centroids: np.ndarray, sums: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for batch in batches:
                if len(batch):
                    whole, norms = _stacked(batch, segments)
                    best, least, _ = nearest(whole, norms, centroids)
                    if not sums:
                        yield pd.DataFrame({"id": batch.id, "none": batch.none, "cluster": best.astype(np.int32), "distance": least})
                    n += np.bincount(best, minlength=len(n))
                    np.add.at(total, best, whole)
            if sums:
                yield pd.DataFrame({"cluster": np.flatnonzero(n), "n": n[n > 0], "total": list(total[n > 0])})

        return run

    for _ in range(rounds if len(centroids) else 0):
        each = stored.mapInPandas(assigned(centroids, True), "cluster int, n long, total array<long>")
        parts = each.select("cluster", "n", F.posexplode("total").alias("at", "value")).groupBy("cluster", "at")
        # Exact beyond 64 bits; k * dims rows.
        centroids = centroids.copy()
        for r in parts.agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect():
            centroids[r.cluster, r["at"]] = int(r.total) // r.n
    done = stored.mapInPandas(assigned(centroids, False), "id long, none boolean, cluster int, distance long")
    done = cut(done if len(centroids) else done.limit(0), "cluster-assigned")
    sums = {r.cluster: r.inertia for r in done.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(i, total, sum(sums.values()), digests[i]) for i, total in sums.items()]
    # One row for each of at most k clusters.
    about = done.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select(F.when(~F.col("none"), F.col("id")).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark, sf_dir):
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    nearest = """a{i} AS MATERIALIZED (
  SELECT r, arg_min(cluster, d) AS cluster, min(d)::BIGINT AS distance FROM (
    SELECT e.r, c.cluster, list_dot_product(e.v, e.v) - 2 * list_dot_product(e.v, c.v) + list_dot_product(c.v, c.v) AS d
    FROM e, c{i} c ORDER BY e.r, d, c.cluster) GROUP BY r)"""
    moved = """m{i} AS MATERIALIZED (
  SELECT cluster, list(part ORDER BY nth) AS v FROM (
    SELECT cluster, nth, floor(sum(x) / count(*)) AS part FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS nth FROM e JOIN a{i} USING (r))
    GROUP BY cluster, nth) GROUP BY cluster),
c{j} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
    parts = [f"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for i in range(rounds):
        parts += [nearest.format(i=i), moved.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT FOR x IN c.v], ',')) AS centroid_sha256
FROM e JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (cluster)"""


OP13_SQL = _sql()
