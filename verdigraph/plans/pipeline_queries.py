"""Queries over metrics, verdicts, run plans and answer groups.

Labels stand for human verdicts (quality 1 is correct), documents for answers: lang for grammar, source for model, doc_id modulo 50 for the question.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigraph.functions import text
from verdigraph.operators import metrics, optimisation, runs
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KS = (1, 3)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reviewed(spark, d):
    """An answer group for each labelled document; its size and covered readings come from its id, each seventh model thinks."""
    met = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    i = F.col("doc_id")
    category = F.when(F.col("toxic") == 1, "Hallucination").when(i % 3 == 0, "Wrong relation").when(i % 3 == 1, "Other").otherwise("")
    return met.select(
        F.col("lang").alias("grammar"), F.col("source").alias("model"), F.when(i % 7 == 0, "True").otherwise("False").alias("thinking"), (i % 50).alias("qid"),
        (1 + i % 5).cast("string").alias("group_size"), F.when(F.col("quality") == 1, " TRUE").otherwise("False").alias("human_correct"), F.lit("1").alias("hypotheses"), category.alias("category"),
    )


REVIEWED = """reviewed AS (
  SELECT lang AS grammar, CASE WHEN doc_id % 7 = 0 THEN source || ' (Thinking)' ELSE source END AS model, doc_id % 50 AS qid, 1 + doc_id % 5 AS size, quality = 1 AS correct,
         CASE WHEN toxic = 1 THEN 'Hallucination' WHEN doc_id % 3 = 0 THEN 'Wrong relation' WHEN doc_id % 3 = 1 THEN 'Other' ELSE '' END AS category
  FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT grammar, model, qid, sum(size)::BIGINT AS n, coalesce(sum(size) FILTER (correct), 0)::BIGINT AS c FROM reviewed GROUP BY ALL),
measured AS (
  SELECT m.*, c / n AS success_rate, c / (n * (1 + qid % 2)) AS hypothesis_coverage, CASE WHEN qid < 25 AND model NOT LIKE '%(Thinking)' THEN (qid * 0.5)::DOUBLE ELSE 0 END AS inference_time,
         CASE WHEN qid < 25 AND model NOT LIKE '%(Thinking)' THEN (10.0 * qid)::DOUBLE ELSE 0 END AS completion_tokens, c / n AS pass_at_1, c / n AS pass_pow_1,
         CASE WHEN c = 0 THEN 0 WHEN n - c < 3 THEN 1 ELSE 1 - ((n - c) / n) * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) END AS pass_at_3, pow(c / n, 3) AS pass_pow_3
  FROM counts m)"""


def measured(spark, d):
    groups = reviewed(spark, d)
    seen = groups.filter("thinking = 'False' AND qid < 25").select("grammar", "model", "thinking", "qid").distinct()
    summaries = seen.withColumns({"inference_time": F.col("qid") * 0.5, "completion_tokens": F.col("qid") * 10.0})
    truths = groups.select("qid").distinct().withColumn("n_readings", 1 + F.col("qid") % 2)
    return metrics.query_metrics(groups, summaries, truths, KS)


@query(f"WITH {REVIEWED} SELECT * FROM measured")
def query_level_metrics(spark, d):
    return measured(spark, d)


@query(f"""WITH {REVIEWED} SELECT grammar, model, avg(success_rate) AS avg_success_rate, avg(hypothesis_coverage) AS avg_hypothesis_coverage, avg(inference_time) AS avg_inference_time,
  avg(completion_tokens) AS avg_completion_tokens, avg(pass_at_1) AS pass_at_1, avg(pass_pow_1) AS pass_pow_1, avg(pass_at_3) AS pass_at_3, avg(pass_pow_3) AS pass_pow_3
  FROM measured GROUP BY grammar, model""")
def model_level_metrics(spark, d):
    return metrics.model_summary(measured(spark, d))


@query(f"""WITH {REVIEWED}, wrong AS (SELECT grammar, model, category, sum(size)::BIGINT AS count FROM reviewed WHERE NOT correct AND category <> '' GROUP BY ALL)
  SELECT *, round_even(100 * count / sum(count) OVER (PARTITION BY grammar, model), 2) AS percentage FROM wrong""")
def error_shares(spark, d):
    return metrics.error_shares(reviewed(spark, d))


@query()
def significance_tests(spark, d):
    return metrics.paired_tests(measured(spark, d), "EN", KS)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN false ELSE quality = 1 END AS correct,
  CASE WHEN doc_id % 4 = 3 OR quality = 1 THEN '' WHEN doc_id % 4 = 0 THEN 'Hallucination' WHEN doc_id % 4 = 1 THEN 'Other' ELSE 'Wrong relation' END AS error_category,
  CASE doc_id % 4 WHEN 3 THEN 'Unparseable judge response: nothing to see' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE 'because ' || doc_id END AS rationale,
  CASE doc_id % 4 WHEN 0 THEN doc_id % 3 ELSE 1 END::INTEGER AS hypotheses_covered, doc_id % 4 = 3 AS judge_failed FROM labels""")
def verdict_rows(spark, d):
    right = F.when(F.col("quality") == 1, "true").otherwise("false")
    said = (
        F.when(F.col("doc_id") % 4 == 0, F.format_string('First\n```json\n{"correct": %s, "error_category": " hallucination", "rationale": " because %d ", "hypotheses_covered": %d}\n```\nand\n```json\n{"note": 1}\n```', right, "doc_id", F.col("doc_id") % 3))
        .when(F.col("doc_id") % 4 == 1, F.format_string('So {"correct": "%s", "error_category": "no such", "rationale": "two\nlines"} it is', F.upper(right)))
        .when(F.col("doc_id") % 4 == 2, F.format_string('"correct": "%s", "error_category": "Wrong relation", "rationale": "because %d", and so on', right, "doc_id"))
        .otherwise("nothing to see")
    )
    return table(spark, d, "labels").select("doc_id", text.verdict_fields(said).alias("v")).select("doc_id", "v.*")


@query("""WITH each AS (SELECT doc_id % 100 AS qid, doc_id AS position, quality = 1 AS correct, CASE WHEN toxic = 1 THEN 'Hallucination' ELSE 'Other' END AS category, 'r' || doc_id AS rationale, doc_id % 11 AS output FROM labels),
  wrong AS (SELECT qid, category, count(*) AS n, min(position) AS first, arg_min(rationale, position) AS rationale FROM each WHERE NOT correct GROUP BY ALL),
  worst AS (SELECT qid, arg_max(category, (n, -first)) AS error, arg_max(rationale, (n, -first)) AS rationale FROM wrong GROUP BY qid)
  SELECT e.*, w.error, w.rationale, false AS judge_failed FROM (SELECT qid, count(*) AS n, avg(correct::INT) AS rate, avg(correct::INT) >= 0.5 AS passed, count(DISTINCT output) AS n_outputs FROM each GROUP BY qid) e LEFT JOIN worst w USING (qid)""")
def question_results(spark, d):
    return optimisation.query_results(_verdicts(spark, d), 0.5)


def _verdicts(spark, d):
    category = F.when(F.col("toxic") == 1, "Hallucination").otherwise("Other")
    return table(spark, d, "labels").select((F.col("doc_id") % 100).alias("qid"), F.col("doc_id").alias("position"), (F.col("doc_id") % 11).alias("output"), (F.col("quality") == 1).alias("correct"), category.alias("category"), F.concat(F.lit("r"), "doc_id").alias("rationale"), F.lit(False).alias("judge_failed"))


@query("""WITH each AS (SELECT doc_id AS qid, quality = 1 AS before, toxic = 0 AS after FROM labels)
  SELECT count(*) FILTER (NOT before AND after) AS fixed, count(*) FILTER (before AND NOT after) AS broken, count(*) FILTER (NOT before AND after) - count(*) FILTER (before AND NOT after) AS net FROM each""")
def candidate_gain(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "qid")
    side = lambda passed: labels.select("qid", passed.alias("passed"))
    return optimisation.net_gain(optimisation.transitions(side(F.col("quality") == 1), side(F.col("toxic") == 0)))


@query("""SELECT doc_id AS qid, quality AS verdict, false AS judge_failed FROM labels WHERE doc_id % 3 > 0 AND doc_id % 2 = 1
  UNION ALL SELECT doc_id, quality, false FROM labels WHERE doc_id % 3 = 0 AND doc_id % 2 = 1 AND doc_id % 5 = 0 UNION ALL SELECT doc_id, toxic, false FROM labels WHERE doc_id % 3 = 0 AND doc_id % 5 > 0""")
def verdict_cache_merge(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "qid")
    cache = labels.filter("qid % 2 = 1").select("qid", F.col("quality").alias("verdict"), F.lit(False).alias("judge_failed"))
    current = labels.filter("qid % 3 = 0").select("qid", F.col("toxic").alias("verdict"), (F.col("qid") % 5 == 0).alias("judge_failed"))
    return optimisation.merged_cache(cache, current, ["qid"])


@query("""SELECT r_name AS grammar, s_name AS model, t.thinking, n_name AS qid, run FROM region, nation, supplier,
  (SELECT unnest([false, true]) AS thinking) t, (SELECT unnest([1, 2]) AS run) WHERE s_suppkey % 4 = 1 AND CASE WHEN s_suppkey % 8 = 1 THEN t.thinking WHEN s_suppkey % 12 = 5 THEN true ELSE NOT t.thinking END""")
def run_plan(spark, d):
    key = F.col("s_suppkey")
    models = table(spark, d, "supplier").select(F.col("s_name").alias("model"), (key % 4 == 1).alias("enabled"), F.when(key % 8 == 1, "high").alias("think_level"), (key % 12 == 5).alias("supports_thinking"))
    return runs.run_plan(table(spark, d, "region").select(F.col("r_name").alias("grammar")), models, table(spark, d, "nation").select(F.col("n_name").alias("qid")), 2)


@query(r"""WITH named AS (SELECT lang, doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS answer FROM documents),
  sized AS (SELECT lang, answer, count(*) AS group_size, min(doc_id) AS first, list(doc_id::VARCHAR ORDER BY doc_id) AS runs FROM named GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY group_size DESC, first) AS place FROM sized""")
def answer_places(spark, d):
    rows = table(spark, d, "documents").select("lang", "text", F.col("doc_id").alias("position"), F.col("doc_id").alias("run"))
    groups = runs.grouped_runs(rows, ["lang"], F.sha1(text.collapse(F.col("text"))))
    return groups.select("lang", "answer", "group_size", F.col("first.position").alias("first"), "runs", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ambrosia' WHEN 1 THEN 'text2cypher' ELSE 'grailqa' END AS dataset, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words FROM documents")
def question_sets(spark, d):
    rows = table(spark, d, "documents").withColumn("qid", F.concat(F.element_at(F.array(*map(F.lit, ("AMB_", "T2C_", "2101"))), (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id")))
    return rows.select("doc_id", runs.dataset_of(F.col("qid")).alias("dataset"), text.word_count(F.col("text")).cast("long").alias("words"))
