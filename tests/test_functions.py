import math

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import stats, text
from verdigraph.operators import answers
from verdigraph.plans.skew import running_total, spread_join
from verdigraph.streaming.ingest import group_stream


def test_pass_at_k_is_the_combinatorial_form(spark):
    rows = [(n, c) for n in range(1, 13) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n long, c long")
    for k in (1, 3, 5):
        for r in df.withColumn("p", stats.pass_at_k(F.col("n"), F.col("c"), k)).collect():
            want = 0.0 if r.c == 0 else 1.0 if r.n - r.c < k else 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k)
            assert r.p == pytest.approx(want)


def test_statistics(spark):
    df = spark.createDataFrame([(0, 0), (3, 3), (10, 2)], "b long, c long").withColumn("x", stats.mcnemar_statistic(F.col("b"), F.col("c"))).withColumn("p", stats.chi_square_tail("x"))
    assert [(round(r.x, 6), round(r.p, 6)) for r in df.collect()] == [(0.0, 1.0), (round(1 / 6, 6), round(math.erfc(math.sqrt(1 / 12)), 6)), (round(49 / 12, 6), round(math.erfc(math.sqrt(49 / 24)), 6))]
    assert stats.wilcoxon_p(0, 5, 0, True) == 2 / 32 and stats.wilcoxon_p(0, 0, 0, True) == 1.0


def test_text(spark):
    row = spark.range(1).select(text.padded_id("AMB_", F.lit(12345)).alias("a"), text.padded_id("AMB_", F.lit(7)).alias("b"), text.safe_name(F.lit("_a b/c:1_")).alias("c"), text.collapse(F.lit(" a \n b ")).alias("d")).first()
    assert tuple(row) == ("AMB_12345", "AMB_0007", "a_b_c_1", "a b")


def test_stratified_sample_has_n_rows(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("s"))
    assert answers.stratified_sample(df, ["s"], 60, 1, "id").count() == 60
    assert answers.stratified_sample(df, ["s"], 600, 1, "id").count() == 500


def test_running_total_and_spread_join(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 10).alias("bucket"), "id", F.lit(1).alias("one"))
    out = running_total(df, "k", "bucket", [F.col("id")], "one", "before")
    assert sorted(r.before for r in out.filter("k = 0").collect()) == list(range(500))
    assert spread_join(df, spark.range(2).withColumnRenamed("id", "k"), ["k"], F.col("id")).count() == 1000


def test_answers_are_grouped_by_grammar(spark, tmp_path):
    said = [
        ("SemGIR", 'So: ```json\n{"b": [1, 2],\n "a": "É x"}\n```'),
        ("SemGIR", '{"a":"\\u00c9 x","b":[1,2]}'),
        ("SemGIR", '{"a": "É  x", "b": [1, 2]}'),
        ("semgir_apo", '{"b": 1, "a": 2'),
        ("semgir_apo", ' {"b":  1,\n"a": 2\u00a0'),
        ("semgir_apo", '{"B": 1, "a": 2'),
        ("semgir_apo", '"\\ud800"'),
        ("squall", '{"b": 1, "a": 2}'),
        ("squall", '{"a": 2, "b": 1}'),
        ("squall", "```sparql\n{\"a\": 2,\u00a0 \"b\": 1}\n```"),
        ("squall", None),
        (None, "x"),
        ("SemGIR", None),
    ]
    rows = [(i, g, "q", t) for i, (g, t) in enumerate(said)]
    want = ['{"a":"É x","b":[1,2]}'] * 2 + ['{"a":"É  x","b":[1,2]}'] + ['{"b": 1, "a": 2'] * 2 + ['{"B": 1, "a": 2', '"\\ud800"', '{"b": 1, "a": 2}'] + ['{"a": 2, "b": 1}'] * 2 + ["", "x", ""]
    df = spark.createDataFrame(rows, "run long, grammar string, qid string, response string")
    assert [r.n for r in df.withColumn("n", text.normal_form(F.col("grammar"), F.col("response"))).orderBy("run").collect()] == want
    df.write.parquet(f"{tmp_path}/runs")
    stream = group_stream(spark, f"{tmp_path}/runs", df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    stream.writeStream.format("memory").queryName("grouped").outputMode("complete").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    groups = {(r.grammar, r.first_run): r["size"] for r in spark.table("grouped").collect()}
    assert groups == {("SemGIR", 0): 2, ("SemGIR", 2): 1, ("SemGIR", 12): 1, ("semgir_apo", 3): 2, ("semgir_apo", 5): 1, ("semgir_apo", 6): 1, ("squall", 7): 1, ("squall", 8): 2, ("squall", 10): 1, (None, 11): 1}
