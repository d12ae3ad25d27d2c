"""The exact searches and the clustering against their SQL and plain loops, on awkward rows."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import clustering, lexical, topk

DOCS, ITEMS, VECTORS = "doc_id long, text string", "item_id long, text string", "vec_id long, embedding array<float>"


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def like_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns, kinds) in tables.items():
        con.sql(f"CREATE TABLE {name} ({', '.join(f'{c} {k}' for c, k in zip(columns, kinds, strict=True))})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", [list(r) for r in rows])
    out = con.sql(sql)
    names = sorted(out.columns)
    at = [out.columns.index(c) for c in names]
    assert sorted(got.columns) == names
    found = plain(got.select(*names).collect())
    assert found == plain([r[i] for i in at] for r in out.fetchall())
    return found


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


# Lexical search.


def prose(rng, n, words=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(70)] + [(7, "W1 w2"), (7, "w1 W2"), (None, "w1 w1 w1"), (None, prose(rng, 30)), (2**60 + 1, "w1 w2 w3"), (900, None), (901, ""), (902, " ,.-"), (903, "ÄW1 äw1 straße w1 w1"), (904, "w3 " * 30_000)]
    items = [(i, prose(rng, rng.randint(1, 25))) for i in range(20)] + [(20, "nowhere"), (21, None), (22, ""), (None, "w1 w2 w2"), (3, "w9 w9 w1"), (23, "äw1 STRASSE W1"), (24, docs[5][1]), (25, prose(rng, 3000))]
    return docs, items


def ranked(spark, docs, items, **options):
    d = clashing(spark.createDataFrame(docs, DOCS).repartition(3), "words", "ids", "item", "score", "rank", "terms")
    return lexical.ranked_search(d, clashing(spark.createDataFrame(items, ITEMS), "doc_id", "terms", "item"), **options)


@pytest.mark.parametrize("postings", [40, 500_000])
def test_lexical_like_sql(spark, texts, monkeypatch, postings):
    docs, items = texts
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    tables = {"documents": (docs, ["doc_id", "text"], ["BIGINT", "VARCHAR"]), "benchmark": (items, ["item_id", "text"], ["BIGINT", "VARCHAR"])}
    assert len(like_sql(ranked(spark, docs, items), lexical.OP11_SQL, **tables)) > 200


def test_lexical_rounds_and_tiny_batches_change_nothing(spark, texts, monkeypatch):
    docs, items = texts
    whole = plain(ranked(spark, docs, items).collect())
    monkeypatch.setattr(lexical, "RANGES", 8)
    assert plain(ranked(spark, docs, items, most_terms=50).collect()) == whole


def test_lexical_empty_tables(spark, texts):
    docs, items = texts
    assert ranked(spark, [], items).count() == 0 and ranked(spark, docs, []).count() == 0 and ranked(spark, [(1, None)], items).count() == 0


@pytest.mark.parametrize("n_docs", [1, 2, 3, 8, 77])
def test_wavelet_tree_like_all_scores(n_docs):
    rng = np.random.default_rng(n_docs)
    found = {(int(d), int(t)): int(rng.integers(1, 9)) for d, t in zip(rng.integers(0, n_docs, 4 * n_docs), rng.integers(0, 12, 4 * n_docs), strict=True)}
    tree = lexical.WaveletTree(np.array([d for d, _ in found]), np.array([t for _, t in found]), np.array([*found.values()]), n_docs)
    for terms in ([0], [1, 2, 3], list(range(12)), [20]):
        weight = rng.integers(0, 5, len(terms))
        scores = Counter()
        for (d, t), impact in found.items():
            if t in terms:
                scores[d] += impact * int(weight[terms.index(t)])
        best = sorted(((-s, d) for d, s in scores.items() if s > 0))[:4]
        docs, got = tree.top(np.array(terms), weight, 4)
        assert [(-s, d) for d, s in zip(docs.tolist(), got.tolist(), strict=True)] == best


def test_lexical_formula(spark):
    docs, items = [(1, "a b a"), (2, "b c"), (3, "")], [(9, "a b b")]
    n, total = 2, 5
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in {"a": 1, "b": 2}.items()}
    part = lambda tf, words: (10**9 * tf) // (1000 * tf + 8 * (25 + (75 * words * n) // total))
    want = {1: weight["a"] * part(2, 3) + 2 * weight["b"] * part(1, 3), 2: 2 * weight["b"] * part(1, 2)}
    assert {r.doc_id: r.score for r in ranked(spark, docs, items).collect()} == want


# Top-k by inner product.


def vectors(seed, n, dims, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(0, scale, dims))]) for i in range(n)]


AWKWARD = [(400, None), (450, [0.1, None, 0.2, 0.1]), (500, [float("nan"), 0.0, 0.0, 0.0]), (550, [float("inf"), 0.0, 0.0, 0.0]), (600, []), (650, [1.0, 2.0]), (651, [1.0, -2.0]), (None, [0.5, 0.5, 0.5, 0.5]), (2**60 + 50, [0.4, 0.5, 0.5, 0.5])]


def close(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(3), "row", "v", "shard", "query", "score", "q", "size")
    return topk.top_k(df, F.col("vec_id") % 50 == 0, 5, **options)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 20, "query_rows": 2}])
def test_topk_like_sql(spark, monkeypatch, options):
    rows = vectors(1, 220, 4) + AWKWARD
    # A third of all rows is one vector, some with one vec_id.
    rows += [(50, rows[3][1]), (50, rows[3][1]), (50, rows[4][1])] + [(1000 + i // 3, rows[3][1]) for i in range(110)]
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "WAITING", 8)
    assert len(like_sql(close(spark, rows, **options), topk.OP12_SQL, embeddings=(rows, ["vec_id", "embedding"], ["BIGINT", "FLOAT[]"]))) > 30


def test_topk_few_and_none(spark):
    rows = vectors(2, 3, 4)
    like_sql(close(spark, rows), topk.OP12_SQL, embeddings=(rows, ["vec_id", "embedding"], ["BIGINT", "FLOAT[]"]))
    assert close(spark, []).count() == 0 and close(spark, rows[1:]).count() == 0 and close(spark, rows[:1]).count() == 0


def test_products_are_exact():
    big = np.array([[2.0**40, 3.0, -(2.0**52)], [1e30, 0, 0]])
    got = topk.products(big, big)
    assert got[0, 0] == min(2**80 + 9 + 2**104, 2**63 - 1) and got[1, 1] == 2**63 - 1
    small = np.floor(np.random.default_rng(0).normal(0, 1e5, (6, 9)))
    assert (topk.products(small, small) == small.astype(np.int64) @ small.astype(np.int64).T).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (12, 16))
    rows = np.floor(np.concatenate([c + rng.normal(0, 20, (90, 16)) for c in centres]))
    tree, queries = topk.BallTree(rows), np.floor(centres)
    bounds = tree.bounds(queries, np.full(12, -np.inf))
    exact = topk.products(queries, rows)
    for i, leaf in enumerate(tree.leaves):
        assert (bounds[:, i] >= exact[:, leaf].max(1)).all()
    kth = np.sort(exact, 1)[:, -5].astype(float)
    assert np.isneginf(tree.bounds(queries, kth)).mean() > 0.5
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(rows)))


# Clustering.


def groups(spark, rows, **options):
    return clustering.clustered(clashing(spark.createDataFrame(rows, VECTORS).repartition(3), "v", "whole", "norms", "cluster", "h"), **options)


@pytest.mark.parametrize("n", [90, 25])
def test_clusters_like_sql(spark, n):
    rows = vectors(5, n, 64) + [(a, v) for a, v in AWKWARD if v is None or len(v) != 4] + [(700, [None] * 64), (701, [float("nan")] + [0.0] * 63), (None, [0.25] * 64)]
    rows += [(5, rows[5][1]), (5, rows[6][1])] + [(800 + i, rows[7][1]) for i in range(n // 2)]
    got = groups(spark, rows)
    like_sql(got, clustering.OP13_SQL, embeddings=(rows, ["vec_id", "embedding"], ["BIGINT", "FLOAT[]"]))
    assert got.count() == n + 3 + n // 2


def test_clusters_of_nothing(spark):
    assert groups(spark, []).count() == 0 and groups(spark, [(1, [0.5] * 63), (2, None)]).count() == 0
    with pytest.raises(ValueError, match="divide"):
        groups(spark, [], segments=7)
    with pytest.raises(Exception, match="beyond"):
        groups(spark, [(1, [1e9] * 64)]).collect()


def test_screening_is_exact_and_drops_centroids():
    rng = np.random.default_rng(6)
    centroids = rng.integers(-300, 300, (40, 64)) * rng.integers(0, 4, (40, 8)).repeat(8, 1)
    rows = centroids[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    best, least, computed = clustering.nearest(rows, clustering.segment_norms(rows, 8), centroids)
    every = ((rows[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all() and computed < 0.5 * every.size
    # Equal centroids: the first.
    same = np.concatenate([centroids, centroids])
    assert (clustering.nearest(rows, clustering.segment_norms(rows, 8), same)[0] == best).all()


def test_clusters_move_as_in_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 6))]) for i in range(50)]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    names = sorted(whole, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:4]
    c = [whole[i] for i in names]
    near = lambda v: min(range(4), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j))
    for _ in range(2):
        own = {i: near(v) for i, v in whole.items()}
        c = [[sum(x) // len(x) for x in zip(*members, strict=True)] if (members := [whole[i] for i in whole if own[i] == j]) else c[j] for j in range(4)]
    got = groups(spark, rows, k=4, rounds=2, dims=6, segments=3, seed=3).collect()
    assert {r.vec_id: r.cluster for r in got} == {i: near(v) for i, v in whole.items()}
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    sums = Counter()
    for r in got:
        sums[r.cluster] += r.distance
    assert all(r.cluster_inertia == sums[r.cluster] for r in got)
