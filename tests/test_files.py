"""Readers and writers on files that are written here."""

import json

import pytest
from pyspark.sql import functions as F

from verdigraph.operators import answers
from verdigraph.sources import files
from verdigraph.streaming import ingest

HEAD = ",".join(files.RUN_COLUMNS)


def record(run, qid, response, error=""):
    return f'{run},m1,False,{qid},"a ""question"",\nlong",10,5,0.25,{response},,2026-01-02T03:04:05,{error}'


@pytest.fixture
def tree(tmp_path):
    at = tmp_path / "run_0001" / "SQL" / "m1"
    at.mkdir(parents=True)
    (at / "q1.csv").write_text("\n".join([HEAD, record(1, "q1", "x"), record("two", "q1", "y")]) + "\n")
    (at / "q2.csv").write_text("\n".join([HEAD, record(1, "q2", "x", "timeout")]) + "\n")
    (at / "summary_per_query.csv").write_text("QID\nq1\n")
    return tmp_path


def test_runs(spark, tree):
    runs = files.read_runs(spark, str(tree / "run_0001" / "SQL" / "m1" / "q*.csv"))
    rows = {(r.QID, r.Response): r for r in runs.collect()}
    assert set(rows) == {("q1", "x"), ("q1", "y"), ("q2", "x")}
    r = rows["q1", "x"]
    assert (r.Run, r.run_dir, r.grammar, r.model_dir, r.Model, r.file, r.Query) == (1, "run_0001", "SQL", "m1", "m1", "q1.csv", 'a "question",\nlong')
    assert (r.Thinking, r["Inference Time (s)"], rows["q1", "y"].Run) == (False, 0.25, None)
    kept = files.finished_only(runs.select("QID", "Error", "Response"), ["QID"])
    assert {r.QID for r in kept.collect()} == {"q1"}


def test_other_columns_are_an_error(spark, tmp_path):
    at = tmp_path / "r" / "g" / "m"
    at.mkdir(parents=True)
    (at / "a.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_strings(spark, str(tmp_path), ["a", "b"]).collect()


def test_resume_with_null_keys(spark):
    runs = spark.createDataFrame([(1, None), (1, "a"), (2, "b")], "q int, m string")
    left = files.not_written(runs, runs.filter("q = 1"), ["q", "m"])
    assert [tuple(r) for r in left.collect()] == [(2, "b")] and files.resumed(runs.filter("q = 1"), left).count() == 3


def test_prompts_questions_and_csv(spark, tmp_path):
    (tmp_path / "EVAL_X.prompt.md").write_text("line\nmore")
    (tmp_path / "note.md").write_text("no")
    assert [tuple(r) for r in files.read_prompts(spark, str(tmp_path)).collect()] == [("EVAL_X", "line\nmore")]
    (tmp_path / "q.json").write_text(json.dumps([{"qid": "1", "question": "?", "graph_query": {"nodes": [{"nid": 0, "id": "m"}], "edges": []}}]))
    assert files.read_questions(spark, str(tmp_path / "q.json")).select("qid", F.col("graph_query.nodes")[0]["id"]).first()[1] == "m"
    files.write_csv(spark.createDataFrame([('a "b"', 1)], "t string, n int"), f"{tmp_path}/out")
    assert [tuple(r) for r in spark.read.options(header=True, escape='"').csv(f"{tmp_path}/out").collect()] == [('a "b"', "1")]


def test_written_runs_prune_folders(spark, tmp_path):
    rows = spark.createDataFrame([("g", "m", True, 1), ("g", "n", False, 2)], "grammar string, Model string, Thinking boolean, Run int")
    files.write_runs(rows, f"{tmp_path}/w")
    assert [r.Run for r in spark.read.parquet(f"{tmp_path}/w").filter("Model = 'n'").collect()] == [2]


def test_streams(spark, tmp_path):
    """Groups of arriving runs as an append log; a batch that runs again replaces what it wrote."""
    rows = [("SQL", "q", " a  b", 1), ("SQL", "q", "a b", 2), ("SemGIR", "q", '{"b": 1, "a": 2}', 3)]
    schema = "grammar string, qid string, response string, run int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.start_append(ingest.group_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/log", f"{tmp_path}/at").awaitTermination()
    assert sorted((r.grammar, r["size"], r.batch) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("SQL", 2, 0), ("SemGIR", 1, 0)]
    spark.createDataFrame([("SemGIR", "q", '{"a":2,"b":1}', 4)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.start_append(ingest.group_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/log", f"{tmp_path}/at").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.grammar, r["size"]) for r in answers.latest(log, ["grammar", "qid", "output_key"], ["batch"]).collect()) == [("SQL", 2), ("SemGIR", 2)]


def test_windowed_counts(spark, tmp_path):
    rows = [("2026-01-01 00:00:01", "a"), ("2026-01-01 00:00:09", "a"), ("2026-01-01 00:00:11", "b")]
    spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) t", "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, k string").parquet(f"{tmp_path}/in")
    counts = ingest.windowed_counts(stream, "t", "k", "10 seconds", "1 minute")
    counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
