"""Queries of the review: documents stand for groups of answers (source for the question), their numbers for judgements and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigraph.operators import review
from verdigraph.operators.metrics import two_measures
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def groups(spark, d):
    k = F.col("doc_id")
    wrong = F.when(k % 7 == 0, F.when(k % 2 == 0, "Wrong relation").when(k % 3 == 0, "bogus").otherwise("Other"))
    key = F.concat(F.coalesce("lang", F.lit("-")), (F.col("n_chars") % 5).cast("string"))
    return table(spark, d, "documents").filter("source IS NOT NULL").select(
        F.col("source").alias("qid"), key.alias("output_key"), k.alias("position"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), (1 + k % 4).alias("size"), (k % 7 != 0).alias("correct"), wrong.alias("category"), F.when(k % 3 != 1, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("rationale"),
    )


_GROUPS = """(SELECT source AS qid, coalesce(lang, '-') || (n_chars % 5) AS output_key, doc_id AS position, 'm' || (doc_id % 3) AS model, 1 + doc_id % 4 AS size, doc_id % 7 <> 0 AS correct,
  CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Wrong relation' WHEN doc_id % 3 = 0 THEN 'bogus' ELSE 'Other' END ELSE '' END AS category, CASE WHEN doc_id % 3 <> 1 THEN 'r' || (doc_id % 3) ELSE '' END AS rationale FROM documents WHERE source IS NOT NULL)"""
_POOL = f"""(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY runs DESC, first, output_key)::INTEGER AS place FROM (SELECT qid, output_key, sum(size)::BIGINT AS runs, list_sort(list(DISTINCT correct)) AS judges,
  CASE WHEN count(DISTINCT correct) > 1 THEN 'mixed' WHEN bool_and(correct) THEN 'correct' ELSE 'wrong' END AS badge, coalesce(list_sort(list(DISTINCT category) FILTER (category <> '')), []) AS categories,
  arg_max(category, (size, -position)) FILTER (category IN ('Wrong relation', 'Other')) AS suggestion, min(position) AS first FROM {_GROUPS} GROUP BY qid, output_key))"""
_DECIDED = f"(SELECT *, CASE first % 3 WHEN 1 THEN true WHEN 2 THEN false END AS verdict, CASE WHEN first % 2 = 0 THEN ' ' ELSE 'because' END AS reason FROM {_POOL})"


def decided(spark, d):
    """Pooled answers with a reviewer's verdict, open for a third, and a reason for every other."""
    own = review.pooled(groups(spark, d), ["qid"])
    return own.withColumn("verdict", F.when(F.col("first") % 3 == 1, True).when(F.col("first") % 3 == 2, False)).withColumn("reason", F.when(F.col("first") % 2 == 0, " ").otherwise("because"))


@query(f"SELECT p.qid, p.output_key, runs, badge, categories, suggestion, place, said FROM {_POOL} p JOIN (SELECT qid, output_key, list(rationale || ':' || models ORDER BY rationale) AS said FROM (SELECT qid, output_key, rationale, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM {_GROUPS} GROUP BY ALL) GROUP BY ALL) USING (qid, output_key)")
def review_answers(spark, d):
    said = F.transform("rationales", lambda r: F.concat(r["rationale"], F.lit(":"), F.array_join(r["models"], ",")))
    return review.pooled(groups(spark, d), ["qid"]).select("qid", "output_key", "runs", "badge", "categories", "suggestion", "place", said.alias("said"))


@query(f"SELECT qid, place, CASE WHEN verdict IS NULL THEN 'no verdict' ELSE 'no reason' END AS problem FROM {_DECIDED} WHERE verdict IS NULL OR (judges <> [verdict] AND trim(reason) = '')")
def review_problems(spark, d):
    return review.problems(decided(spark, d), ["qid"])


@query(f"SELECT qid, output_key, v AS verdict, CASE WHEN v IS NOT NULL THEN judges <> [v] END AS discrepancy FROM (SELECT *, coalesce(verdict, CASE WHEN len(judges) = 1 THEN judges[1] END) AS v FROM {_DECIDED})")
def review_filled(spark, d):
    """Open verdicts are the judges' where these agree; then what differs from the judges."""
    return review.discrepancies(review.accept_judge(decided(spark, d))).select("qid", "output_key", "verdict", "discrepancy")


@query(f"WITH q AS (SELECT qid, bool_and(verdict IS NOT NULL) AS done, min(first) AS position FROM {_DECIDED} GROUP BY qid) SELECT qid FROM q WHERE NOT done ORDER BY position > (SELECT position FROM q WHERE qid = 'src5') DESC, position LIMIT 1")
def review_next(spark, d):
    queries = decided(spark, d).groupBy("qid").agg(F.bool_and(F.col("verdict").isNotNull()).alias("done"), F.min("first").alias("position"))
    return review.next_open(queries, "src5")


@query(f"SELECT qid, output_key AS output, correct, count(*) AS size, min(position) AS first FROM {_GROUPS} GROUP BY qid, output_key, correct")
def review_marks(spark, d):
    return review.marks(groups(spark, d).withColumnRenamed("output_key", "output"))


_TAGS = "['lang:' || coalesce(lang, '-'), 'source:' || coalesce(source, '-'), 'size:' || (n_chars // 500)]"


@query(
    f"""WITH p AS (SELECT doc_id AS qid, md5('9|' || doc_id) AS o, {_TAGS} AS tags FROM documents), e AS (SELECT qid, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth FROM p), c AS (SELECT tag, count(*) AS n FROM e GROUP BY tag),
r AS (SELECT qid, arg_min(tag, n * 100000 + nth) AS tag FROM e JOIN c USING (tag) GROUP BY qid), k AS (SELECT qid, tag, o, row_number() OVER (PARTITION BY tag ORDER BY o, qid) <= round_even(count(*) OVER (PARTITION BY tag) * 0.2, 0) AS taken FROM r JOIN p USING (qid)),
f AS (SELECT *, sum(CASE WHEN taken THEN 0 ELSE 1 END) OVER (ORDER BY o, qid) AS place FROM k)
SELECT qid, tag, CASE WHEN taken OR place <= (SELECT round_even(count(*) * 0.2, 0) - count(*) FILTER (taken) FROM k) THEN 'val' ELSE 'train' END AS split FROM f"""
)
def rarest_tag_split(spark, d):
    """A validation fifth that has its share of every rare tag."""
    tags = F.array(F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("-"))), F.concat(F.lit("source:"), F.coalesce("source", F.lit("-"))), F.concat(F.lit("size:"), F.floor(F.col("n_chars") / 500).cast("string")))
    return review.rarest_tag_split(table(spark, d, "documents").select(F.col("doc_id").alias("qid"), tags.alias("tags")), 0.2, 9)


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}_count, round_even(100.0 * count(*) FILTER (event_type = '{t}') / count(*), 2)::DOUBLE AS {t}_percentage" for t in ("view", "error", "click", "signup")) + " FROM events WHERE event_type <> 'purchase' GROUP BY user_id")
def error_two_pivot(spark, d):
    """Counts and shares of each error as columns, 0 where there is none."""
    counts = table(spark, d, "events").filter("event_type <> 'purchase'").groupBy("user_id", F.col("event_type").alias("category")).agg(F.count("*").alias("count"))
    return two_measures(counts, ["user_id"], ["view", "error", "click", "signup"])
