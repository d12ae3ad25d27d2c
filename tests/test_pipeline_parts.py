"""Question sets, verdicts, metrics and the optimisation loop against small cases worked out by hand or by loops."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import text
from verdigraph.operators import metrics, optimisation, runs
from verdigraph.sources import datasets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def verdicts(spark, *said):
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    return [tuple(r.v) for r in rows.orderBy("i").select(text.verdict_fields(F.col("t")).alias("v")).collect()]


def test_verdicts(spark):
    got = verdicts(
        spark,
        '```json\n{"correct": false, "error_category": "WRONG relation ", "rationale": " r ", "hypotheses_covered": "2"}\n```\n```json\n{"a": 1}\n```',
        'I think {"correct": "True", "error_category": "Hallucination"} so',
        '{"correct": false, "rationale": "two\nlines", "hypotheses_covered": 1.5}',
        'x "correct": "FALSE", "error_category": "Other", "rationale": "left, right", "hypotheses_covered": 3',
        '"correct": true',
        "no",
        None,
    )
    assert got == [
        (False, "Wrong relation", "r", 2, False),
        (True, "", "", 1, False),
        (False, "Other", "two\nlines", 1, False),
        (False, "Other", "left, right", 3, False),
        (True, "", '"correct": true', 1, False),
        (False, "", "Unparseable judge response: no", 1, True),
        (False, "", "Unparseable judge response: ", 1, True),
    ]


def test_names_and_sections(spark):
    graph = {"nodes": [{"nid": 0, "node_type": "class", "id": "m.a", "class": "c.a", "friendly_name": "Big City"}, {"nid": 1, "node_type": "entity", "id": "m.ab", "class": "c.b", "friendly_name": "Oslo"}, {"nid": 2, "node_type": "literal", "id": "3^^int", "class": "t", "friendly_name": "three"}], "edges": [{"start": 0, "end": 1, "relation": "r.x", "friendly_name": "is in"}, {"start": 0, "end": 1, "relation": "m.a", "friendly_name": "later"}]}
    kind = "struct<nodes:array<struct<nid:int,node_type:string,id:string,class:string,friendly_name:string>>,edges:array<struct<start:int,end:int,relation:string,friendly_name:string>>>"
    names = one(spark, text.friendly_names(F.from_json(F.lit(json.dumps(graph)), kind)))
    assert names == {"m.a": "later", "c.a": "Big_City", "m.ab": "Oslo", "3^^int": "3", "t": "3", "r.x": "is_in"}
    prompt = "You are.\n\n## INSTRUCTIONS\nDo this.\nAnd that.\n## OUTPUT\nJSON\n"
    parts = one(spark, text.sections(F.lit(prompt)))
    assert tuple(parts) == ("You are.\n\n", "Do this.\nAnd that.\n", "## OUTPUT\nJSON\n") and one(spark, text.sections(F.lit("none"))) is None
    assert one(spark, text.with_instructions(text.sections(F.lit(prompt)), F.lit("New."))) == prompt.replace("Do this.\nAnd that.", "New.")
    assert one(spark, text.tagged(F.lit("a <Rationale> why\nso </RATIONALE>"), "rationale")) == "why\nso" and one(spark, text.tagged(F.lit("a"), "x")) is None
    assert one(spark, text.unified_diff(F.lit("a\nb"), F.lit("a\nc"))).split("\n")[-2:] == ["-b", "+c"]
    assert str(one(spark, text.iso_time(F.lit("2026-01-02T03:04:05.678901")))) == "2026-01-02 03:04:05" and one(spark, text.iso_time(F.lit("soon"))) is None
    assert [one(spark, text.word_count(F.lit(t))) for t in (" a  b c\n", "", None)] == [3, 0, 0]
    readings = F.array(F.struct(F.lit("m").alias("meaning"), F.lit("S").alias("sql")))
    assert one(spark, text.judge_section(F.lit("ambrosia"), F.lit(""), readings)) == "[GROUND TRUTH SQL]\nInterpretation 1:\nMeaning: m\nSQL: S\n\n"
    assert one(spark, text.judge_section(F.lit("x"), F.lit("(f)"), readings)) == "[GROUND TRUTH LISP]\n(f)\n"


def test_question_sets(spark, tmp_path):
    head = ",question_type,ambig_question,question,gold_queries,db_file,db_dump,is_ambiguous,ambig_type,domain,split"
    rows = ["3,ambig,Q1,Q1,,a.db,,True,scope,d,train", '4,unambig,Q1,"means ""this"",\nor so",SELECT 1,a.db,,False,scope,d,train', "12345,ambig,Q2,Q2,,a.db,,TRUE,attachment,d,test", "6,ambig,Q3,Q3,,a.db,,True,vague,d,train", "7,unambig,Q1,other base,SELECT 2,b.db,,False,scope,d,train"]
    (tmp_path / "q.csv").write_text("\n".join([head, *rows]) + "\n")
    got = {r.id: r for r in datasets.load_ambiguous_questions(spark, str(tmp_path / "q.csv")).collect()}
    assert set(got) == {"AMB_0003", "AMB_12345"} and [tuple(x) for x in got["AMB_0003"].readings] == [('means "this",\nor so', "SELECT 1")] and got["AMB_12345"].readings == []
    assert datasets.load_ambiguous_questions(spark, str(tmp_path / "q.csv"), "test").count() == 1
    (tmp_path / "bad.csv").write_text(head.replace("ambig_question,question", "question,ambig_question") + "\n" + rows[0] + "\n")
    with pytest.raises(Exception, match="has the columns"):
        datasets.load_ambiguous_questions(spark, str(tmp_path / "bad.csv")).collect()
    table = [("q", "MATCH (n)\\nRETURN n", "s1", "instance_id_7", "db"), ("q", "MATCH (n) SET n.x = 1", "s1", "instance_id_8", "db"), ("q", "RETURN 1", "s2", "instance_id_9", "db")]
    spark.createDataFrame(table, datasets.CYPHER).write.parquet(f"{tmp_path}/c")
    cyphers = datasets.load_cypher_questions(spark, f"{tmp_path}/c", ["s2"])
    assert [(r.id, r.cypher) for r in cyphers.collect()] == [("T2C_7", "MATCH (n)\nRETURN n")]
    (tmp_path / "g.json").write_text(json.dumps([{"qid": "210100000001", "question": "a", "s_expression": "(AND m.1)", "graph_query": {"nodes": [{"id": "m.1", "node_type": "entity", "friendly_name": "The One"}], "edges": []}}, {"qid": "210200000002", "question": "b"}]))
    graph = datasets.load_graph_questions(spark, str(tmp_path / "g.json"), spark.createDataFrame([("2102000099",)], "qid string"))
    assert [(r.qid, r.function, r.template) for r in graph.collect()] == [("210100000001", "none", "21010000")]
    truths = datasets.ground_truths(graph, datasets.load_ambiguous_questions(spark, str(tmp_path / "q.csv")), cyphers)
    assert {(r.qid, r.dataset, r.content, r.n_readings) for r in truths.collect()} == {("210100000001", "grailqa", "(AND The_One)", 1), ("AMB_0003", "ambrosia", "", 1), ("AMB_12345", "ambrosia", "", 1), ("T2C_7", "text2cypher", "MATCH (n)\nRETURN n", 1)}


def test_run_plan(spark):
    models = spark.createDataFrame([("a", True, None, False), ("b", True, None, True), ("c", True, "high", True), ("d", False, None, True)], "model string, enabled boolean, think_level string, supports_thinking boolean")
    plan = runs.run_plan(spark.createDataFrame([("g",), ("h",)], "grammar string"), models, spark.createDataFrame([("q",), ("r",)], "qid string"), 3)
    assert {tuple(r) for r in plan.collect()} == {(g, m, t, q, n) for g in "gh" for m, t in (("a", False), ("b", False), ("b", True), ("c", True)) for q in "qr" for n in (1, 2, 3)}
    both = runs.options(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, both) == {"a": "1", "b": "3"} and one(spark, runs.options(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"))) == {"a": "1"}
    prompts = spark.createDataFrame([(0, "GIR", "first"), (1, "SEM_GIR", "second"), (2, "SEM_GIR_APO", "exact")], "position int, name string, text string")
    got = runs.with_prompt(spark.createDataFrame([("SEM_GIR_APO",), ("SEM_GIR_X",), ("SQL",)], "grammar string"), prompts).collect()
    assert {r.grammar: r.prompt for r in got} == {"SEM_GIR_APO": "exact", "SEM_GIR_X": "first", "SQL": None}
    clock = lambda *x: one(spark, runs.seconds(*[F.lit(v).cast("long") for v in x]))
    assert (clock(1_500_000_000, 1, 2), clock(0, 10**9, 5 * 10**8), clock(None, 10**9, None)) == (1.5, 1.5, 1.0)


def fold(groups, same, threshold):
    """The order-dependent merge by a loop."""
    core = [a for a, n in groups if n > threshold] or [groups[0][0]]
    out = {a: a for a in core}
    for a, _ in groups:
        if a not in out:
            out[a] = next((c for c in core if (a, c) in same), a)
            core += [a] if out[a] == a else []
    return out


def test_groups_and_merges(spark):
    rng = random.Random(2)
    rows, same = [], []
    for q in range(25):
        answers = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 12))]
        rows += [(q, 100 * q + i, str(i) if i % 3 else f"x{i}", a) for i, a in enumerate(answers)]
        same += [(q, x, y) for x, y in itertools.permutations(sorted(set(answers)), 2) if rng.random() < 0.3]
    groups = runs.grouped_runs(spark.createDataFrame(rows, "qid int, position int, run string, response string"), ["qid"], F.col("response"))
    got = runs.merged_groups(groups, spark.createDataFrame(same, "qid int, answer string, other string"), ["qid"], 1).collect()
    for q in range(25):
        own = sorted((r for r in got if r.qid == q), key=lambda r: r["first"].position)
        assert {r.answer: r.into for r in own} == fold([(r.answer, r.group_size) for r in own], {(a, b) for k, a, b in same if k == q}, 1)
        assert [r.answer for r in sorted(own, key=lambda r: r.place)] == [r.answer for r in sorted(own, key=lambda r: -r.group_size)]
        assert all(r.runs == sorted(r.runs, key=lambda x: (x.startswith("x"), x if x.startswith("x") else int(x))) for r in own)


def test_paired_tests(spark):
    rng = random.Random(4)
    rows = []
    for q in range(9):
        for g in ("Base", "other"):
            c = rng.choice([0, 5, 10])
            rows += [(g, "m", "False", q, "10", "x", "0", "Other")] if c == 0 else [(g, "m", "False", q, str(c), "True", "1", "")] + [(g, "m", "False", q, str(10 - c), "False", "0", "Other")] * (c < 10)
    reviewed = spark.createDataFrame(rows, "grammar string, model string, thinking string, qid int, group_size string, human_correct string, hypotheses string, category string")
    none = spark.createDataFrame([], "grammar string, model string, thinking string, qid int, inference_time double, completion_tokens double")
    measured = metrics.query_metrics(reviewed, none, spark.createDataFrame([], "qid int, n_readings int"), (1, 3))
    rate = {(r.grammar, r.qid): r.success_rate for r in measured.collect()}
    got = {(r.metric, r.test): r for r in metrics.paired_tests(measured, "base", (1, 3)).collect()}
    d = [rate["Base", q] - rate["other", q] for q in range(9)]
    size = sorted(abs(x) for x in d if x)
    rank = {s: sum(i for i, v in enumerate(size, 1) if v == s) / size.count(s) for s in size}
    up, down = sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)
    assert (got["success_rate", "Wilcoxon"].statistic, got["success_rate", "Wilcoxon"].n) == (min(up, down), len(size))
    assert 0 <= got["success_rate", "Wilcoxon"].p <= 1 and got["pass_at_3", "McNemar"].n == 9
    assert metrics.formatted(metrics.model_summary(measured)).first().avg_inference_time == "0.00"


def test_loop_tables(spark):
    log = spark.createDataFrame([(0, "kept"), (1, "rejected"), (2, "kept"), (3, "rejected"), (4, "rejected")], "iteration int, status string")
    assert [r.iteration for r in optimisation.last_rejected(log, 2).collect()] == [3, 4]
    assert sorted(r.iteration for r in optimisation.rejected_since_kept(log).collect()) == [3, 4]
    assert optimisation.rejected_since_kept(log.filter("status = 'rejected'")).count() == 3
    results = spark.createDataFrame([(1, 0.9, True, False, "train", None), (2, 0.1, False, False, "train", "Other"), (3, 0.1, False, True, "train", "Other"), (4, 0.2, False, False, "val", "Other")], "qid int, rate double, passed boolean, judge_failed boolean, split string, error string")
    assert [r.qid for r in optimisation.failing(results).collect()] == [2] and [tuple(r) for r in optimisation.by_category(optimisation.failing(results)).collect()] == [("Other", 1, [2])]
    assert not optimisation.all_pass(results).first()[0] and optimisation.all_pass(results.limit(0)).first()[0]
    assert optimisation.mean_rate(results, spark.createDataFrame([(1,), (2,)], "qid int")).first()[0] == pytest.approx(0.5) and optimisation.mean_rate(results, results.limit(0)).first()[0] == 0
    changes = optimisation.transitions(results, results.withColumn("passed", F.col("qid") == 2))
    assert tuple(optimisation.net_gain(changes).first()) == (1, 1, 0) and [r.qid for r in optimisation.regressions(changes).collect()] == [1]
    cache = spark.createDataFrame([(1, "h1", "o"), (2, "old", "o"), (None, "h", "o")], "qid int, truth_hash string, output string")
    assert [r.qid for r in optimisation.valid_cache(cache, spark.createDataFrame([(1, "h1"), (2, "new")], "qid int, truth_hash string")).collect()] == [1]
