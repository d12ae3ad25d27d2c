"""The review's tables on a handful of rows, and the split by rarest tag against a plain loop."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from verdigraph.operators import metrics, review, runs

GROUPS = "qid string, output_key string, position int, model string, size int, correct boolean, category string, rationale string"


def test_pooled_answers(spark):
    rows = [
        ("q", "a", 1, "m1", 3, True, "", "good"), ("q", "a", 2, "m2", 5, False, "Other", None), ("q", "a", 3, "m1", 5, False, "Wrong relation", None), ("q", "a", 4, "m3", 9, False, "made up", "good"),
        ("q", "b", 5, "m1", 22, True, None, ""), ("q", "c", 6, "m1", 22, False, "", ""),
    ]
    got = {r.output_key: r for r in review.pooled(spark.createDataFrame(rows, GROUPS), ["qid"]).collect()}
    assert [(k, r.runs, r.badge, r.place) for k, r in sorted(got.items())] == [("a", 22, "mixed", 1), ("b", 22, "correct", 2), ("c", 22, "wrong", 3)]
    assert got["a"].suggestion == "Other" and got["a"].categories == ["Other", "Wrong relation", "made up"] and got["b"].suggestion is None
    assert [(x.rationale, x.models) for x in got["a"].rationales] == [("", ["m1", "m2"]), ("good", ["m1", "m3"])]


def test_decisions(spark):
    rows = [("q", 1, None, [True], ""), ("q", 2, None, [False, True], ""), ("q", 3, True, [False], " "), ("q", 4, True, [False], "because"), ("q", 5, False, [False, True], None), ("q", 6, True, [True], None)]
    df = spark.createDataFrame(rows, "qid string, place int, verdict boolean, judges array<boolean>, reason string")
    assert sorted(tuple(r) for r in review.problems(df, ["qid"]).collect()) == [("q", 1, "no verdict"), ("q", 2, "no verdict"), ("q", 3, "no reason"), ("q", 5, "no reason")]
    filled = {r.place: (r.verdict, r.discrepancy) for r in review.discrepancies(review.accept_judge(df)).collect()}
    assert filled == {1: (True, False), 2: (None, None), 3: (True, True), 4: (True, True), 5: (False, True), 6: (True, False)}


def test_next_open(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", True), (4, "d", False)], "position int, qid string, done boolean")
    at = lambda q, rows=df: [r.qid for r in review.next_open(rows, q).collect()]
    assert at("b") == ["d"] and at("d") == ["a"] and at("a") == ["d"] and at(None) == ["a"] and at("unknown") == ["a"] and at("b", df.filter("done")) == []


def plain_split(pool, fraction, seed):
    order = lambda q: (hashlib.md5(f"{seed}|{q}".encode()).hexdigest(), q)
    counts = Counter(t for tags in pool.values() for t in tags)
    rarest = {q: min(tags, key=lambda t: counts[t]) if tags else None for q, tags in pool.items()}
    by = defaultdict(list)
    for q, t in rarest.items():
        if t is not None:
            by[t].append(q)
    val = {q for own in by.values() for q in sorted(own, key=order)[: round(len(own) * fraction)]}
    rest = sorted(set(pool) - val, key=order)
    return rarest, val | set(rest[: max(0, round(len(pool) * fraction) - len(val))])


def test_rarest_tag_split(spark):
    pool = {f"q{i}": ["all", *(["odd"] if i % 2 else []), f"own{i // 2}" if i < 20 else f"many{i % 3}"] for i in range(80)} | {"none": []}
    rarest, val = plain_split(pool, 0.25, 3)
    got = review.rarest_tag_split(spark.createDataFrame([*pool.items()], "qid string, tags array<string>"), 0.25, 3).collect()
    assert {r.qid: r.tag for r in got} == rarest and {r.qid for r in got if r.split == "val"} == val and len(val) == round(81 * 0.25)


def test_places_with_null_keys_and_many_positions(spark):
    rows = [(None, 1, 10), (None, 1, 20_000), (None, 1, 5), (None, 3, 50_000), ("k", 2, 1)]
    df = spark.createDataFrame(rows, "k string, size int, position int")
    got = {(r.k, r.position): r.place for r in runs.placed(df, ["k"], "size", F.col("position"), F.col("position")).collect()}
    assert got == {(None, 50_000): 1, (None, 5): 2, (None, 10): 3, (None, 20_000): 4, ("k", 1): 1}


def test_two_measures(spark):
    df = spark.createDataFrame([("u", "a", 1), ("u", "b", 3), ("v", "z", 2)], "k string, category string, count int")
    assert metrics.two_measures(df, ["k"], ["a", "c"]).orderBy("k").collect() == [("u", 1, 25.0, 0, 0.0), ("v", 0, 0.0, 0, 0.0)]
