"""Queries of the reports: documents stand for judged answers and for the log of reviews, labels for validation runs and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigraph.operators import answers, metrics, optimisation, reports
from verdigraph.plans.pipeline_queries import _verdicts, REVIEWED, reviewed as judged
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reviewed(spark, d):
    docs = table(spark, d, "documents").withColumn("i", F.col("doc_id"))
    key = F.concat_ws("|", F.coalesce("lang", F.lit("-")), F.col("i") % 40, F.col("n_chars") % 7)
    said = F.when(F.col("i") % 3 == 0, "True").when(F.col("i") % 3 == 1, "false")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    evaluated = docs.select(
        name("run", F.col("i") % 2).alias("run"), F.col("lang").alias("grammar"), F.col("source").alias("model"), F.col("i").alias("qid"), F.md5("text").alias("question"), key.alias("output_key"),
        said.alias("correct"), F.when(F.col("i") % 4 > 0, name("r", F.col("i"))).alias("rationale"), F.col("n_chars").cast("string").alias("representative"),
    )
    wrong = F.col("i") % 2 == 1
    log = docs.filter("n_chars % 3 > 0").select(
        key.alias("output_key"), "i", (~wrong).alias("human_correct"), (F.col("i") % 4).alias("human_hypotheses"), F.when(F.col("i") % 5 > 0, name("why", F.col("i"))).alias("discrepancy_reason"),
        F.when(wrong, "Other").alias("error_category"), name("note", F.col("i")).alias("error_notes"), name("t", F.col("i")).alias("reviewed_at"), F.when(F.col("i") % 7 > 0, name("run", F.col("i") % 2)).alias("run"),
    )
    return reports.reviewed_answers(evaluated, answers.latest(log, ["output_key"], ["i"]).drop("i"))


_KEY = "coalesce(lang, '-') || '|' || doc_id % 40 || '|' || n_chars % 7"
_REVIEWED = f"""WITH e AS (SELECT 'run' || doc_id % 2 AS run, lang AS grammar, source AS model, doc_id AS qid, md5(text) AS question, {_KEY} AS output_key, CASE doc_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END AS correct,
  CASE WHEN doc_id % 4 > 0 THEN 'r' || doc_id END AS rationale, n_chars::VARCHAR AS representative FROM documents),
l AS (SELECT {_KEY} AS output_key, max(doc_id) AS i FROM documents WHERE n_chars % 3 > 0 GROUP BY ALL),
m AS (SELECT e.*, i, i % 2 = 0 AS human_correct, (i % 2 = 0) <> (correct IS NOT NULL AND correct = 'True') AS discrepancy, CASE WHEN i % 5 > 0 THEN 'why' || i ELSE '' END AS reason, CASE WHEN i % 7 > 0 THEN 'run' || i % 2 END AS home FROM e JOIN l USING (output_key)),
r AS (SELECT run, grammar, model, qid, question, output_key, correct, rationale, representative, human_correct, i % 4 AS human_hypotheses, discrepancy,
  CASE WHEN NOT discrepancy THEN '' WHEN home = run THEN reason ELSE trim('(verdict reused from run ' || coalesce(home, '?') || ') ' || reason) END AS discrepancy_reason,
  CASE WHEN i % 2 = 1 THEN 'Other' END AS error_category, 'note' || i AS error_notes, 't' || i AS reviewed_at, coalesce(home, '') AS reviewed_in FROM m)"""


@query(f"{_REVIEWED} SELECT * FROM r")
def review_export(spark, d):
    """Judged answers with the last verdict of their key, from whichever run it comes."""
    return reviewed(spark, d)


@query(f"{_REVIEWED} SELECT run, qid, question, grammar, model, error_category, error_notes, representative FROM r WHERE NOT human_correct")
def review_model_errors(spark, d):
    return reports.model_errors(reviewed(spark, d))


@query(f"{_REVIEWED} SELECT run, qid, question, grammar, model, correct AS judge_said, human_correct AS human_said, discrepancy_reason, rationale FROM r WHERE discrepancy")
def review_judge_errors(spark, d):
    return reports.judge_errors(reviewed(spark, d))


@query("""WITH q AS (SELECT doc_id AS qid, source, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, md5(text) AS question FROM documents),
  v AS (SELECT doc_id % 100 AS qid, doc_id, quality = 1 AS correct, CASE WHEN toxic = 1 THEN 'Hallucination' ELSE 'Other' END AS category, doc_id % 11 AS output FROM labels),
  s AS (SELECT qid, avg(correct::INT) AS rate, count(DISTINCT output) AS n_outputs FROM v GROUP BY qid)
  SELECT qid, source, split, question, doc_id // 100 + 1 AS run, CASE WHEN doc_id % 3 > 0 THEN 'raw' || output ELSE '' END AS raw, output::VARCHAR AS candidate, correct, category, 'r' || doc_id AS rationale, rate, n_outputs
  FROM v JOIN q USING (qid) JOIN s USING (qid)""")
def validation_rows(spark, d):
    """The runs of the validated queries beside their results; queries are the documents that the runs name."""
    verdicts = _verdicts(spark, d)
    queries = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "source", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"), F.md5("text").alias("question"))
    raw = F.when(F.col("position") % 3 > 0, F.concat(F.lit("raw"), F.col("output").cast("string")))
    runs = verdicts.select("qid", (F.floor(F.col("position") / 100) + 1).alias("run"), raw.alias("raw"), F.col("output").cast("string").alias("candidate"), "correct", "category", "rationale")
    return reports.validation_rows(queries, runs, optimisation.query_results(verdicts, 0.5))


@query("""WITH log AS (SELECT doc_id // 10 AS iteration, doc_id AS position, CASE WHEN quality = 1 AND toxic = 0 THEN 'KEEP' WHEN toxic = 1 THEN 'CHAMPION_INIT' ELSE 'DISCARD' END AS status FROM labels)
  SELECT (SELECT position FROM log WHERE status <> 'DISCARD' ORDER BY iteration DESC, position DESC LIMIT 1) AS position, (SELECT max(iteration) + 1 FROM log) AS next_iteration""")
def experiment_state(spark, d):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "KEEP").when(F.col("toxic") == 1, "CHAMPION_INIT").otherwise("DISCARD")
    log = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 10).alias("iteration"), F.col("doc_id").alias("position"), status.alias("status"))
    return reports.experiment_state(log).select("champion.position", "next_iteration")


_CATEGORIES = ("Hallucination", "Wrong relation", "Other", "Wrong entity")


@query(f"""WITH {REVIEWED}, wrong AS (SELECT grammar, model, category, sum(size)::BIGINT AS count FROM reviewed WHERE NOT correct AND category <> '' GROUP BY ALL),
  shared AS (SELECT *, round_even(100 * count / sum(count) OVER (PARTITION BY grammar, model), 2) AS percentage FROM wrong),
  grid AS (SELECT * FROM (SELECT DISTINCT grammar, model FROM wrong), (SELECT unnest({list(_CATEGORIES)}) AS category))
  SELECT g.*, coalesce(count, 0) AS count, coalesce(percentage, 0) AS percentage FROM grid g LEFT JOIN shared s ON g.grammar IS NOT DISTINCT FROM s.grammar AND g.model IS NOT DISTINCT FROM s.model AND g.category = s.category""")
def error_grid(spark, d):
    """Error shares with a row for each category, also those that a model has none of."""
    return reports.reindexed(metrics.error_shares(judged(spark, d)), ["grammar", "model"], "category", _CATEGORIES, ["count", "percentage"])


@query("""SELECT 'q' || doc_id AS qid, trim(coalesce(lang, '') || ' ' || n_chars) AS question, source, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN doc_id % 3 = 0 THEN '[{"target":' || n_chars || '}]' END AS solution, CASE WHEN doc_id % 3 = 0 THEN '[{"target":' || n_chars || '}]' ELSE 'MATCH ' || doc_id END AS truth, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_features FROM documents""")
def pool_entries(spark, d):
    """Queries of pool texts, which are JSON maps made of documents."""
    i = F.col("doc_id").cast("string")
    solution = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.col("n_chars").alias("target"))))
    truth = F.when(F.col("doc_id") % 3 > 0, F.struct(F.lit("text2cypher").alias("dataset"), F.concat(F.lit("MATCH "), i).alias("cypher")))
    features = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    entry = F.struct(F.concat_ws(" ", F.coalesce("lang", F.lit("")), "n_chars", F.lit("")).alias("query"), "source", split.alias("split"), solution.alias("solution"), truth.alias("ground_truth"), features.alias("features"))
    pools = table(spark, d, "documents").select(F.to_json(F.create_map(F.concat(F.lit("q"), i), entry)).alias("pool"))
    found = reports.pool_entries(pools, "pool")
    known = F.coalesce(F.col("ground_truth")["semgir_json"], F.col("ground_truth")["cypher"])
    return found.select("qid", "question", "source", "split", "solution", known.alias("truth"), F.coalesce(F.size("features"), F.lit(0)).alias("n_features"))
