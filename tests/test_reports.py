"""Report rows worked out by hand, and report files written and read again."""

import json

from verdigraph.operators import reports
from verdigraph.sources import reports as files

EVALUATED = "run string, qid string, question string, grammar string, model string, output_key string, correct string, rationale string, representative string"
REVIEWS = "output_key string, human_correct boolean, human_hypotheses int, discrepancy_reason string, error_category string, error_notes string, reviewed_at string, run string"


def reviewed(spark):
    answers = [("r1", "q1", "Which?", "SQL", "m", key, correct, "because", "x") for key, correct in (("a", "TRUE"), ("b", "False"), ("c", None), ("d", "true"), ("e", "True"), (None, "True"))]
    reviews = [("a", True, 1, "ignored", None, None, "t", "r1"), ("b", True, 2, "judge was strict", None, None, "t", "r1"), ("c", False, 0, "x", "Other", "n", "t", "r0"), ("d", False, 0, None, "Other", "n", "t", "r0"), ("e", False, 0, "y", None, None, "t", None), ("z", True, 1, "", None, None, "t", "r1"), (None, True, 1, "", None, None, "t", "r1")]
    return reports.reviewed_answers(spark.createDataFrame(answers, EVALUATED), spark.createDataFrame(reviews, REVIEWS))


def test_reviewed_answers(spark):
    got = {r.output_key: (r.human_correct, r.discrepancy, r.discrepancy_reason, r.reviewed_in) for r in reviewed(spark).collect()}
    assert got == {
        "a": (True, False, "", "r1"), "b": (True, True, "judge was strict", "r1"), "c": (False, False, "", "r0"),
        "d": (False, True, "(verdict reused from run r0)", "r0"), "e": (False, True, "(verdict reused from run ?) y", ""),
    }
    assert sorted(r.error_category or "" for r in reports.model_errors(reviewed(spark)).collect()) == ["", "Other", "Other"]
    assert sorted((r.judge_said, r.human_said) for r in reports.judge_errors(reviewed(spark)).collect()) == [("False", True), ("True", False), ("true", False)]


def test_error_reports_by_run(spark, tmp_path):
    headers = files.REPORTS["judge_llm_errors"]
    files.write_report(reports.judge_errors(reviewed(spark)), headers, str(tmp_path / "judge"), ("run",))
    back = files.read_report(spark, str(tmp_path / "judge" / "_run=r1"), headers)
    assert {(r.judge_said, r.human_said, r.discrepancy_reason) for r in back.collect()} == {("False", "True", "judge was strict"), ("true", "False", "(verdict reused from run r0)"), ("True", "False", "(verdict reused from run ?) y")}


def test_validation_rows(spark):
    queries = spark.createDataFrame([("q", "s", "val", "Who?"), ("none", "s", "val", "?")], "qid string, source string, split string, question string")
    runs = spark.createDataFrame([("q", 1, None, None, False, None, "no"), ("q", 2, "raw", "c", True, None, ""), ("other", 1, "r", "c", True, "", "")], "qid string, run int, raw string, candidate string, correct boolean, category string, rationale string")
    results = spark.createDataFrame([("q", 0.5, 2), ("other", 1.0, 1)], "qid string, rate double, n_outputs int")
    got = reports.validation_rows(queries, runs, results)
    assert sorted(map(tuple, got.collect())) == [("q", "s", "val", "Who?", 1, "", "", False, "", "no", 0.5, 2), ("q", "s", "val", "Who?", 2, "raw", "c", True, "", "", 0.5, 2)]
    assert got.columns == list(files.REPORTS["validation"].values())


def test_experiment_state(spark, tmp_path):
    path = tmp_path / "experiments.json"
    entries = [(0, "CHAMPION_INIT"), (0, "CHAMPION_INIT"), (1, "KEEP"), (2, "DISCARD")]
    path.write_text(json.dumps([{"iteration": i, "status": s, "score": 0.5} for i, s in entries], indent=2))
    state = lambda log: [(r.champion and (r.champion.iteration, r.champion.position), r.next_iteration) for r in reports.experiment_state(log).collect()]
    log = files.read_experiments(spark, str(path))
    assert state(log) == [((1, 2), 3)] and state(log.filter("iteration = 0")) == [((0, 1), 1)]
    assert state(log.filter("status = 'DISCARD'")) == [(None, 3)] and state(log.limit(0)) == [(None, 1)]
    path.write_text("not an array")
    assert files.read_experiments(spark, str(path)).count() == 0


def test_reindexed(spark):
    df = spark.createDataFrame([("a", "x", 3, 0.5), (None, "y", 2, 1.0), ("b", "other", 1, 1.0)], "k string, c string, n int, share double")
    got = reports.reindexed(df, ["k"], "c", ["x", "y"], ["n", "share"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "x", 3, 0.5), ("a", "y", 0, 0.0), (None, "x", 0, 0.0), (None, "y", 2, 1.0), ("b", "x", 0, 0.0), ("b", "y", 0, 0.0)], key=str)


def test_pool(spark, tmp_path):
    pool = {
        "q1": {"query": " Who? ", "source": "handwritten", "split": "train", "solution": [{"target": "a", "entities": []}], "rubric_features": ["x"]},
        "q2": {"query": "What?", "source": "t2c", "split": "val", "ground_truth": {"dataset": "text2cypher", "cypher": "MATCH (n)\nRETURN n"}, "features": ["f", "g"]},
    }
    (tmp_path / "pool.json").write_text(json.dumps(pool, indent=2))
    got = {r.qid: r for r in files.read_pool(spark, str(tmp_path / "pool.json")).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"].question == "Who?" and json.loads(got["q1"].solution) == pool["q1"]["solution"]
    assert got["q1"].ground_truth["dataset"] == "semgir" and json.loads(got["q1"].ground_truth["semgir_json"]) == pool["q1"]["solution"] and got["q1"].rubric_features == ["x"]
    assert (got["q2"].solution, got["q2"].ground_truth, got["q2"].features) == (None, pool["q2"]["ground_truth"], ["f", "g"])
    texts = spark.createDataFrame([("[]",), ("{",), (None,), ("{}",)], "t string")
    assert reports.pool_entries(texts, "t").count() == 0


def metrics_frames(spark, rate):
    query = spark.createDataFrame([("SQL", "m", "q,\n1", rate, 1.0, 0.25, 7.0, rate, 0.5)], "grammar string, model string, qid string, success_rate double, hypothesis_coverage double, inference_time double, completion_tokens double, pass_at_1 double, pass_pow_1 double")
    model = spark.createDataFrame([("SQL", "m", "0.5000", "1.0000", "0.25", "7.00", "0.5000", "0.5000")], "grammar string, model string, avg_success_rate string, avg_hypothesis_coverage string, avg_inference_time string, avg_completion_tokens string, pass_at_1 string, pass_pow_1 string")
    errors = spark.createDataFrame([], "grammar string, model string, category string, count long, percentage double")
    tests = spark.createDataFrame([("m", "SQL", "x", "McNemar", 0.01, True)], "model string, grammar string, metric string, test string, p double, significant boolean")
    return {"query_level_metrics": query, "model_summary_metrics": model, "error_distribution": errors.filter("count > 1"), "significance_tests": tests}


def test_metrics_of_the_latest_run(spark, tmp_path):
    at = str(tmp_path / "metrics")
    for run, rate in (("run_0002", 0.75), ("run_0001", 0.25)):
        files.write_metrics(at, run, metrics_frames(spark, rate), [1], "EN")
    assert files.latest_run(spark, at, "query_level_metrics") == "run_0002"
    back = files.read_latest_metrics(spark, at, [1], "EN")
    row = back["query_level_metrics"].first()
    assert (row.qid, row.success_rate, row.pass_pow_1) == ("q,\n1", "0.75", "0.5") and back["model_summary_metrics"].first().avg_inference_time == "0.25"
    assert back["error_distribution"].count() == 0 and back["significance_tests"].first().significant == "True" and back["significance_tests"].first().baseline == "EN"
    # A table without rows is its header.
    header = [p.read_text() for p in (tmp_path / "metrics" / "run_0002" / "error_distribution.csv").glob("part-*")]
    assert header == ["Grammar,Model,Error Category,Count,Percentage\n"]
    # Plain files of another program are found too.
    (tmp_path / "metrics" / "run_0003").mkdir()
    (tmp_path / "metrics" / "run_0003" / "query_level_metrics.csv").write_text("Grammar\n")
    assert files.latest_run(spark, at, "query_level_metrics") == "run_0003"


def test_lists_and_truth_values(spark, tmp_path):
    df = spark.createDataFrame([("m", False, "q", 'say "x"', "k", 2, "x,y", None, True, [1, 2])], "model string, thinking boolean, qid string, question string, output_key string, group_size int, representative string, reasoning string, merged boolean, runs array<int>")
    files.write_report(df, files.REPORTS["grouped"], str(tmp_path / "g"))
    r = files.read_report(spark, str(tmp_path / "g"), files.REPORTS["grouped"]).first()
    assert (r.thinking, r.merged, r.runs, r.question, r.representative, r.reasoning) == ("False", "True", "1, 2", 'say "x"', "x,y", None)
