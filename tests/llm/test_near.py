from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import near
from verdigraph.llm.components import components


def brute(rows, threshold=0.8):
    """doc_id -> (class_id, copy_id, n_copies, n_links) by comparing all pairs of word 5-grams."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    by_gram = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in by_gram.get(g, ()))
        for j, both in shared.items():
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for g in s:
            by_gram.setdefault(g, []).append(i)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    out = []
    for i in range(n):
        same = [j for j in range(n) if sets[j] == sets[i]] if sets[i] else [i]
        out.append((rows[i][0], min(rows[j][0] for j in groups[root(i)]), min(rows[j][0] for j in same), len(same), links[i]))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "copy_id", "n_copies", "n_links").collect())


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    base = words(rng, 120)
    out = [(i, " ".join(words(rng, int(rng.integers(1, 60))))) for i in range(40)]
    for i in range(40, 90):
        copy = list(base)
        for _ in range(int(rng.integers(0, 3))):
            copy[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9)}"
        out.append((i, " ".join(copy)))
    return [*out, (90, None), (91, ""), (92, "one two"), (93, "two one"), (94, "one\ttwo"), (95, "\n \t"), (95, "\n \t")]


def test_like_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1)).withColumn("row", F.lit("clash"))
    assert result(near.near_join(docs)) == brute(rows)


def test_cells_of_several_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 900)
    assert result(near.near_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_and_null_ids(spark):
    assert near.near_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near.near_join(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.class_id or -1, r.n_links) for r in got) == [(False, 3, 1), (True, -1, 0), (True, 3, 1)]


def test_one_of_each(spark, rows):
    docs = spark.createDataFrame([*rows, rows[50]], "doc_id long, text string").withColumn("extra", F.lit(5))
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted({r[0] for r in brute(rows) if r[0] == r[1]})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_one_of_each_with_shared_and_null_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (1, b), (1, " "), (2, a + " x"), (None, b + " x"), (None, c), (None, c + " x"), (None, c), (None, None), (None, "")]
    kept = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), (r.text or "").strip()[:1]) for r in kept) == [(0, ""), (0, "c"), (1, ""), (1, "a"), (1, "b")]


def test_bands():
    for recall in (0.9, 0.99, 0.999):
        bands, r = near.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**r) ** bands >= recall and bands * r <= 140


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
