"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Each shard has a ball tree. A node with centre c and radius r holds no vector whose product with q exceeds q.c + |q| r, so nodes are taken by that bound
and dropped below the kth score so far. A query first searches one shard to the end; the kth score that it has there is shared with all other shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut

#: Rows of a shard, queries that meet it in one task, vectors of a leaf, and found rows that wait to be merged.
SHARD, QUERIES, LEAF, WAITING = 16_384, 32_768, 64, 1 << 20
#: Below this, sums of products are exact in doubles.
EXACT = 2.0**53
NONE = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vectors: pd.Series) -> np.ndarray:
    """Rows of floor(256 x), whole numbers in doubles."""
    return np.floor(256.0 * np.stack(vectors.to_list()).astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``; beyond 64 bits the nearest long."""
    if np.abs(a).sum(1).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """A balanced tree over the rows of ``vectors``; every leaf has about LEAF rows. Nodes of one level stand together."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        groups = [np.arange(len(vectors))]
        while True:
            centres = np.array([vectors[g].mean(0) for g in groups])
            # A little more than the distance, for rounding.
            radii = np.array([np.sqrt(((vectors[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres, strict=True)]) * (1 + 1e-9)
            self.levels.append((centres, radii))
            if len(groups[0]) <= LEAF:
                break
            groups = [half for g in groups for half in self._halves(vectors[g], g)]
        self.leaves = groups

    @staticmethod
    def _halves(own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = own[((own - own[0]) ** 2).sum(1).argmax()]
        other = own[((own - one) ** 2).sum(1).argmax()]
        order = np.argsort(own @ (other - one), kind="stable")
        return rows[order[: (len(rows) + 1) // 2]], rows[order[(len(rows) + 1) // 2 :]]

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query and leaf the bound of its products, or minus infinity where the leaf or a node above is below ``least``."""
        length = np.sqrt((queries**2).sum(1)) * (1 + 1e-9)
        live = np.ones((len(queries), 1), bool)
        for centres, radii in self.levels:
            if len(radii) > live.shape[1]:
                live = np.repeat(live, 2, 1)
            bound = queries @ centres.T + length[:, None] * radii
            bound = np.maximum(bound + 1e-9 * np.abs(bound) + 1e-6, -(2.0**63))
            live &= bound >= least[:, None]
        return np.where(live, bound, -np.inf)


def search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, score: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the ``k`` best vectors for each query among those before (``score``, ``last``), its kth score so far and that row's id.

    A row comes before another if its score is higher, or equal and its id smaller. A query's own row takes no part.
    """
    tree = BallTree(vectors)
    score, last = score.copy(), last.copy()
    none = np.zeros(0, np.int64)
    best = (none, none, none)
    bounds = tree.bounds(queries, score)
    order = np.argsort(-bounds, axis=1, kind="stable")
    waiting: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        nonlocal best
        q, place, got = (np.concatenate(x) for x in zip(best, *waiting, strict=True))
        waiting.clear()
        by = np.lexsort((ids[place], -got, q))
        q, place, got = q[by], place[by], got[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kth = nth == k - 1
        score[q[kth]], last[q[kth]] = got[kth], ids[place[kth]]
        best = (q[nth < k], place[nth < k], got[nth < k])

    at, width = 0, 1
    while at < order.shape[1]:
        leaf = order[:, at : at + width]
        bound = np.take_along_axis(bounds, leaf, 1)
        q, col = np.nonzero((bound >= score[:, None]) & (bound > -np.inf))
        if not len(q):
            break
        of = leaf[q, col]
        by = np.argsort(of, kind="stable")
        q, of = q[by], of[by]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for own, n in zip(np.split(q, starts[1:]), of[starts], strict=True):
            places = tree.leaves[n]
            got = products(queries[own], vectors[places])
            good = (got > score[own, None]) | ((got == score[own, None]) & (ids[places][None] < last[own, None]))
            i, j = np.nonzero(good & (rows[places][None] != query_rows[own, None]))
            waiting.append((own[i], places[j], got[i, j]))
            if sum(len(x[0]) for x in waiting) > WAITING:
                merge()
        if waiting:
            merge()
        at, width = at + width, 2 * width
    return best


def top_k(vectors: DataFrame, queries: Column, k: int, vector: str = "embedding", shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors(vec_id, embedding)`` where ``queries`` holds, the ``k`` other rows with the highest products.

    Components x count as floor(256 x); a score is the exact integer product (beyond 64 bits the nearest long), equal scores come by ascending vec_id, null last.
    A vector that is null or has a component that is null or not finite takes no part, as query or otherwise; the empty vector only meets empty ones, as a
    vector meets only those of its own length. A row doesn't find itself, but finds its copies, and a repeated query is answered as often as it is there.
    An empty table or one without queries gives an empty result. Other columns aren't read, whatever their names.

    Shards and blocks of queries have about ``shard_rows`` and ``query_rows`` rows, dealt by a number of the row, so copies or a repeated vec_id don't meet in one task.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(usable(F.col("v")))
    kept = cut(own.withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "topk-vectors")
    n, n_asked = kept.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    spread = lambda salt, m: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = kept.select(F.coalesce("vec_id", F.lit(NONE)).alias("id"), "row", "v", "dims", spread(1, shards).alias("shard"))
    names = [F.col(a).alias(b) for a, b in {"vec_id": "query_id", "row": "query", "v": "q", "dims": "size"}.items()]
    asked = kept.filter("asks").select(*names, spread(2, shards).alias("home"), spread(3, blocks).alias("part"))

    def cell(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(there):
            ids = there.id.to_numpy()
            kth = [asking[c].to_numpy() for c in ("score", "last")]
            q, place, score = search(scaled(there.v), ids, there.row.to_numpy(), scaled(asking.q), asking["query"].to_numpy(), *kth, k)
            out = [asking["query"].to_numpy()[q], asking.query_id.to_numpy()[q], ids[place], score]
        return pd.DataFrame(dict(zip(("query", "query_id", "id", "score"), out or [[]] * 4, strict=True)), dtype="int64")

    found = "query long, query_id long, id long, score long"
    low = {"score": F.lit(np.iinfo(np.int64).min), "last": F.lit(NONE)}
    first = asked.withColumns(low).groupBy("home", "size").cogroup(held.groupBy("shard", "dims"))
    first = cut(first.applyInPandas(cell, found), "topk-first")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    nth = first.withColumn("rank", F.row_number().over(by))
    kth = nth.filter(F.col("rank") == k).select("query", "score", F.col("id").alias("last"))
    told = asked.join(kth, "query", "left").withColumns({c: F.coalesce(c, x) for c, x in low.items()})
    others = told.withColumn("to", all_of(shards)).filter("to <> home").groupBy("to", "part", "size")
    rest = others.cogroup(held.withColumn("block", all_of(blocks)).groupBy("shard", "block", "dims")).applyInPandas(cell, found)
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("id", F.lit(NONE)).alias("vec_id"), "score")


def op12_topk(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP12_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
