"""Shortest paths, named graphs, sequence patterns, set similarity, tags and streamed completeness, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import questions, sequences, text
from verdigraph.operators import graph, similarity
from verdigraph.streaming.completeness import completed


def plain_shortest(edges, start, longest):
    """The least predecessor at each hop, then read backwards."""
    via, level, known = {}, {start}, set()
    for hop in range(1, longest + 1):
        new = {}
        for a, role, b in sorted(edges):
            if a in level and b not in known:
                new.setdefault(b, (hop, a, role))
        known |= new.keys()
        via |= new
        level = set(new)
    out = {}
    for end, (hops, a, role) in via.items():
        nodes, roles, at = [end], [], end
        for h in range(hops, 0, -1):
            _, a, role = via[at]
            assert via[at][0] == h
            nodes.insert(0, a)
            roles.insert(0, role)
            at = a
        out[end] = (hops, nodes, roles)
    return out


def test_shortest_paths(spark):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(25):02d}", rng.choice(["x", "y", "z"]), f"n{rng.randrange(25):02d}") for _ in range(60)}
    g = graph.Graph(None, spark.createDataFrame([*edges, *list(edges)[:5]], "src string, role string, dst string"))
    starts = spark.createDataFrame([("n00",), ("n01",), ("n01",), ("nowhere",)], "start_id string")
    got = {(r.start_id, r.end_id): (r.hops, r.nodes, r.roles) for r in graph.shortest_paths(g, starts).collect()}
    assert got == {(s, e): v for s in ("n00", "n01") for e, v in plain_shortest(edges, s, 30).items()}
    ends = spark.createDataFrame([("n05",), ("n06",)], "end_id string")
    few = {(r.start_id, r.end_id): r.hops for r in graph.shortest_paths(g, starts, ends, 3, ["x", "y"]).collect()}
    want = {(s, e): v[0] for s in ("n00", "n01") for e, v in plain_shortest({x for x in edges if x[1] != "z"}, s, 3).items() if e in ("n05", "n06")}
    assert few == want
    assert graph.shortest_paths(g, starts.limit(0)).count() == 0


def test_named_graphs(spark):
    nodes = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T")], "id string, type string")
    g = graph.Graph(nodes, spark.createDataFrame([("knows", "a", "b", "g1"), ("knows", "b", "c", "g1"), ("knows", "b", "c", "g2")], "role string, src string, dst string, graph string"))
    chain = lambda one, two: graph.relate(graph.relation(graph.named(g, one), "x", "y", "knows"), graph.named(g, two), "y", "z", "knows")
    assert [tuple(r) for r in chain("g", "g").select("x_id", "z_id", "g_graph").collect()] == [("a", "c", "g1")]
    assert sorted(tuple(r) for r in chain("g", "h").select("x_id", "g_graph", "h_graph").collect()) == [("a", "g1", "g1"), ("a", "g1", "g2")]


def plain_matches(items, pattern):
    if items is None:
        return []
    out = []

    def go(i, p, bound):
        if p == len(pattern):
            if i == len(items):
                out.append(dict(bound))
        elif pattern[p] == "...":
            for j in range(i, len(items) + 1):
                go(j, p + 1, bound)
        elif i < len(items):
            x = items[i]
            if pattern[p] == "_" or (pattern[p].startswith("?") and (pattern[p][1:] not in bound or bound[pattern[p][1:]] == x)):
                go(i + 1, p + 1, {**bound, pattern[p][1:]: x} if pattern[p].startswith("?") else bound)
            elif pattern[p] == x:
                go(i + 1, p + 1, bound)

    go(0, 0, {})
    return out


@pytest.mark.parametrize("pattern", [["a", "?x", "...", "_"], ["...", "?x", "?x", "..."], ["?x", "...", "?x"], ["..."], ["a", "b"], ["?x"], ["...", "a", "...", "?y", "b", "..."], ["?x", "?y", "...", "?y", "...", "?x"], ["_", "..."], []])
def test_sequences(spark, pattern):
    rng = random.Random(6)
    rows = [[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(60)] + [None, ["a", None, None, "b"], [None]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, items array<string>")
    got = {r.i: sorted((tuple(sorted(m.asDict().items())) for m in r.m), key=repr) for r in df.select("i", sequences.matches(F.col("items"), pattern).alias("m")).collect()}
    plain = lambda m: tuple(sorted(m.items())) if m or any(p.startswith("?") for p in pattern) else (("matched", True),)
    assert got == {i: sorted(map(plain, plain_matches(r, pattern)), key=repr) for i, r in enumerate(rows)}


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_like_all_pairs(spark, threshold):
    rng = random.Random(9)
    rows = [(i, [f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randint(1, 12))]) for i in range(90)]
    rows += [(100 + i, [*rows[i][1], "extra"]) for i in range(20)] + [(200 + i, rows[3][1]) for i in range(40)] + [(300, []), (301, None), (302, [None, "w1"]), (303, ["w1", "w1"])]
    sets = {i: {w for w in ws or [] if w} for i, ws in rows}
    sets = {i: s for i, s in sets.items() if s}
    got = {r.id: r for r in similarity.linked(spark.createDataFrame(rows, "i long, w array<string>"), "i", "w", threshold).collect()}
    assert got.keys() == sets.keys()
    for i, s in sets.items():
        near = [plain_jaccard(s, t) for j, t in sets.items() if j != i]
        other = [x for j, t in sets.items() if (x := plain_jaccard(s, t)) >= threshold and t != s]
        assert (got[i].class_id, got[i].copies, got[i].links) == (min(j for j, t in sets.items() if t == s), sum(t == s for t in sets.values()), sum(x >= threshold for x in near))
        assert got[i].best == pytest.approx(max(other)) if other else got[i].best is None


def test_best_matches(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, ["c", "b", "a"])], "i long, w array<string>")
    right = spark.createDataFrame([(10, ["a", "b", "d"]), (11, ["d", "b", "a"]), (12, ["q"])], "i long, w array<string>")
    assert sorted(tuple(r) for r in similarity.best_matches(left, right, "i", "w", 0.5).collect()) == [(1, 10, 0.5), (3, 10, 0.5)]


def test_functions_and_questions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(questions.functions(F.lit("RETURN size(n.name), size(x), Date(''), date(n.d), id(n), n.id (x), apoc.x"))) == sorted(["size() or length() of a property", "size(list)", "date() or datetime() with a value", "date() or datetime() without a value", "id()", "text and list functions"])
    assert one(questions.functions(F.lit(""))) == [] and one(questions.functions(F.lit(None).cast("string"))) is None
    x, y = (spark.createDataFrame([(t,) for t in rows], "tags array<string>") for rows in ([["a", "b"], ["a"], []], [["b"], ["c"]]))
    got = questions.populations(x, y, spark.createDataFrame([("a",), ("z",)], "element string")).orderBy("element").collect()
    assert [tuple(r) for r in got] == [("a", 2, 0, 66.7, 0.0, "x_only"), ("b", 1, 1, 33.3, 50.0, "both"), ("c", 0, 1, 0.0, 50.0, "y_only"), ("z", 0, 0, 0.0, 0.0, "neither")]


def test_verdicts_with_a_null_field_and_headings(spark):
    said = ['```json\n{"correct": null, "error_category": "Other", "rationale": "r"}\n```', '{"correct": true, "hypotheses_covered": 2.7}', '{"incorrect": true}']
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(text.verdict_fields(F.col("t")).alias("v")).collect()
    assert [(r.v.correct, r.v.hypotheses_covered, r.v.judge_failed) for r in rows] == [(False, 1, False), (True, 2, False), (False, 1, True)]
    parts = text.sections(F.lit("Intro\n## Instructions\nDo.\n\n---\n\n## EXAMPLES\nx\n---\n"))
    got = spark.range(1).select(parts.alias("p"), text.assembled(parts, F.lit("\nNew. ")).alias("t")).first()
    assert tuple(got.p) == ("Intro\n", "Do.\n\n", "---\n\n## EXAMPLES\nx\n---\n")
    assert got.t == "Intro\n\n## INSTRUCTIONS\n\nNew.\n\n---\n\n## EXAMPLES\nx\n---\n"


def test_completeness_with_late_repeated_and_missing_runs_and_a_restart(spark, tmp_path):
    schema = "qid string, run int, output string, correct boolean, ts timestamp"
    row = lambda qid, run, minute, output="x", correct=True: (qid, run, output, correct, f"2024-01-01 00:{minute:02d}:00")
    waves = [
        [row("a", 1, 0), row("a", 2, 1, "y", False), row("b", 1, 1), (None, 1, "x", True, "2024-01-01 00:00:00")],
        # a is complete now; one run comes twice, with another answer that doesn't count.
        [row("a", 2, 2, "z"), row("a", 3, 3), row("b", 2, 3)],
        # A late run of a changes nothing; c moves the watermark far beyond the patience for b.
        [row("a", 4, 4), row("c", 1, 50), row("c", 2, 50), row("c", 3, 50, None, None)],
        [row("d", 1, 55)], [row("d", 2, 56)],
    ]

    def run(wave):
        rows = spark.createDataFrame([(*r[:4], r[4]) for r in wave], "qid string, run int, output string, correct boolean, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # A query of its own for each wave, so each begins as after a restart.
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = completed(stream, 3, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema("qid string, output string, correct boolean, size int, first_run int, n_runs int, complete boolean").parquet(f"{tmp_path}/out").collect()), key=repr)

    whole_a = [("a", "x", True, 2, 1, 3, True), ("a", "y", False, 1, 2, 3, True)]
    assert run(waves[0]) == [] and run(waves[1]) == whole_a
    after = run(waves[2])
    assert [r for r in after if r[0] == "a"] == whole_a and [r for r in after if r[0] == "c"] == [("c", "x", True, 2, 1, 3, True), ("c", None, False, 1, 3, 3, True)]
    run(waves[3])
    end = run(waves[4])
    assert [r for r in end if r[0] == "b"] == [("b", "x", True, 2, 1, 2, False)] and not [r for r in end if r[0] == "d"]
    assert len(end) == len(set(end)) == len(list(itertools.chain(whole_a, after[2:]))) + (0 if any(r[0] == "b" for r in after) else 1)


def test_similar_sets_shuffle_no_items_to_rank_them(spark, monkeypatch):
    written, cut = {}, similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name, **more: written.setdefault(name, cut(df, name, **more)) if name not in written else cut(df, name, **more))
    # All items in one cell, so that hashes alone order them.
    monkeypatch.setattr(similarity, "CELLS", 1, raising=False)
    rows = [(i, [f"w{(i * 7 + j) % 23}" for j in range(12)]) for i in range(46)]
    got = {r.id: r.links for r in similarity.linked(spark.createDataFrame(rows, "i long, w array<string>"), "i", "w", 0.6).collect()}
    assert got == {i: sum(plain_jaccard(set(w), set(v)) >= 0.6 for j, v in rows if j != i) for i, w in rows}
    assert "similar-ranks" not in written and dict(written["similar-prefixes"].dtypes)["item"] == "bigint"


def test_populations_of_counted_rows(spark):
    x = spark.createDataFrame([(["a", "b"], 3), (["a"], 1)], "tags array<string>, n long")
    y = spark.createDataFrame([(["b"], 2), ([], 6)], "tags array<string>, n long")
    got = {r.element: (r.n_x, r.n_y, r.share_x, r.share_y, r.side) for r in questions.populations(x, y, spark.createDataFrame([("c",)], "element string"), rows="n").collect()}
    assert got == {"a": (4, 0, 100.0, 0.0, "x_only"), "b": (3, 2, 75.0, 25.0, "both"), "c": (0, 0, 0.0, 0.0, "neither")}


def test_shortest_paths_write_no_last_hop(spark, monkeypatch):
    edges = spark.createDataFrame([("x", "a", "b"), ("x", "a", "b"), ("w", "a", "c"), ("x", "b", "d"), ("w", "c", "d"), ("w", "b", "d")], "role string, src string, dst string")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (written.append(name), cut(df, name))[1])
    found = graph.shortest_paths(graph.Graph(None, edges), spark.createDataFrame([("a",)], "start_id string"), None, 2)
    assert {r.end_id: (r.hops, r.nodes, r.roles) for r in found.collect()} == {"b": (1, ["a", "b"], ["x"]), "c": (1, ["a", "c"], ["w"]), "d": (2, ["a", "b", "d"], ["x", "w"])}
    assert len(written) == 2


def test_rows_across_graphs(spark):
    seen = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, None), ("c", 1, "x")]
    got = graph.across(spark.createDataFrame(seen, "c_id string, p_id int, g_graph string"), "g", "h")
    assert got.columns == ["c_id", "p_id", "g_graph", "h_graph"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x", "y"), ("a", 1, "x", "z"), ("a", 1, "y", "z")]


@pytest.mark.parametrize("large", [4, 16, 64])
def test_pairs_of_near_copies_are_one_row_each_and_meet_in_blocks(spark, monkeypatch, large):
    written, cut = {}, similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name, **more: written.setdefault(name, cut(df, name, **more)) if name not in written else cut(df, name, **more))
    kept = []
    monkeypatch.setattr(similarity, "drop", kept.append)
    # Small limits, so that few sets are a large cluster and short ones need several items.
    for name, value in (("LARGE", large), ("BLOCK", 200), ("MEMBER", 8)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    rng = random.Random(4)
    near = [(i, [f"c{j}" for j in range(40) if j != i % 41]) for i in range(50)]
    apart = [(100 + i, [f"s{i % 15}", *[f"r{rng.randint(0, 400)}" for _ in range(rng.randint(3, 30))]]) for i in range(60)]
    rows = [*near, *apart, (200, [*apart[0][1], "more"]), (201, near[0][1])]
    got = {r.id: (r.copies, r.links) for r in similarity.linked(spark.createDataFrame(rows, "i long, w array<string>"), "i", "w", 0.8).collect()}
    sets = {i: set(w) for i, w in rows}
    assert got == {i: (sum(t == s for t in sets.values()), sum(j != i and plain_jaccard(s, t) >= 0.8 for j, t in sets.items())) for i, s in sets.items()}
    different = {frozenset(s) for s in sets.values()}
    alike = sum(plain_jaccard(s, t) >= 0.8 for s, t in itertools.combinations(different, 2))
    assert alike <= written["similar-candidates"].count() <= alike + 5 and not written.keys() & {"similar-wanted", "similar-pairs"}
