"""Rows of the reports that a run leaves: reviewed answers and what they say of models and judges, validation runs, the state of the experiments, full grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of experiments that became the champion.
KEPT = ("CHAMPION_INIT", "KEEP")


def reviewed_answers(evaluated: DataFrame, reviews: DataFrame) -> DataFrame:
    """``evaluated`` with human_correct, human_hypotheses, discrepancy, discrepancy_reason, error_category, error_notes, reviewed_at and reviewed_in; answers without a review are left out.

    ``evaluated`` has run, output_key and correct (text; only ``true`` in any case is true) beside what else is reported. ``reviews(output_key, human_correct, human_hypotheses,
    discrepancy_reason, error_category, error_notes, reviewed_at, run)`` has one row for each key, as ``answers.latest`` makes of a log. A verdict holds for its key in every run; the
    discrepancy is against the judge of the answer's own run, and its reason tells where the verdict comes from another one. A verdict from no known run counts as another's.
    Without a discrepancy the reason is empty. Missing reasons are empty; null keys have no review.
    """
    given = reviews.select("output_key", F.struct(*[c for c in reviews.columns if c != "output_key"]).alias("_review"))
    met = evaluated.join(given, "output_key")
    said = F.lower(F.coalesce(F.col("correct").cast("string"), F.lit(""))) == "true"
    differs = F.col("_review.human_correct") != said
    reason = F.coalesce(F.col("_review.discrepancy_reason"), F.lit(""))
    reused = F.trim(F.concat(F.lit("(verdict reused from run "), F.coalesce("_review.run", F.lit("?")), F.lit(") "), reason))
    told = F.when(~differs, "").when(F.col("_review.run").eqNullSafe(F.col("run")), reason).otherwise(reused)
    same = {c: F.col(f"_review.{c}") for c in ("human_correct", "human_hypotheses", "error_category", "error_notes", "reviewed_at")}
    return met.withColumns({**same, "discrepancy": differs, "discrepancy_reason": told, "reviewed_in": F.coalesce("_review.run", F.lit(""))}).drop("_review")


def model_errors(reviewed: DataFrame) -> DataFrame:
    """The reviewed answers that a human found wrong, with what was wrong about them."""
    return reviewed.filter(~F.col("human_correct")).select("run", "qid", "question", "grammar", "model", "error_category", "error_notes", "representative")


def judge_errors(reviewed: DataFrame) -> DataFrame:
    """The reviewed answers on which the judge and the human differ."""
    return reviewed.filter("discrepancy").select("run", "qid", "question", "grammar", "model", F.col("correct").alias("judge_said"), F.col("human_correct").alias("human_said"), "discrepancy_reason", "rationale")


def validation_rows(queries: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each run of the validated queries, with its query's rate and number of distinct outputs.

    ``queries(qid, source, split, question)``, ``runs(qid, run, raw, candidate, correct, category, rationale)``, ``results(qid, rate, n_outputs)``. Missing outputs and categories are empty.
    Runs of other queries and queries without runs have no rows.
    """
    empty = {c: F.coalesce(c, F.lit("")) for c in ("raw", "candidate", "category")}
    met = runs.withColumns(empty).join(queries.select("qid", "source", "split", "question"), "qid").join(results.select("qid", "rate", "n_outputs"), "qid")
    return met.select("qid", "source", "split", "question", "run", "raw", "candidate", "correct", "category", "rationale", "rate", "n_outputs")


def experiment_state(log: DataFrame, order: Sequence[str] = ("iteration", "position"), kept: Sequence[str] = KEPT) -> DataFrame:
    """One row: ``champion`` (the last of the kept experiments, null without one) and ``next_iteration``, 1 for an empty log."""
    last = F.max_by(F.struct(*log.columns), F.when(F.col("status").isin(*kept), F.struct(*order)))
    return log.agg(last.alias("champion"), (F.coalesce(F.max("iteration"), F.lit(0)) + 1).alias("next_iteration"))


def reindexed(df: DataFrame, keys: Sequence[str], dimension: str, values: Sequence, measures: Sequence[str]) -> DataFrame:
    """keys, dimension, measures: a row of ``df(keys, dimension, measures)`` for each key and each of ``values``, of 0 where there is none; other values are left out.

    ``values`` are those of a chart's axis, a short list. Null keys are keys.
    """
    grid = df.select(*keys).distinct().withColumn(dimension, F.explode(F.array(*map(F.lit, values))))
    same = F.col(f"g.`{dimension}`") == F.col(f"d.`{dimension}`")
    for k in keys:
        same &= F.col(f"g.`{k}`").eqNullSafe(F.col(f"d.`{k}`"))
    filled: list[Column] = [F.coalesce(f"d.`{m}`", F.lit(0)).alias(m) for m in measures]
    return grid.alias("g").join(df.alias("d"), same, "left").select("g.*", *filled)


def pool_entries(pool: DataFrame, text: str) -> DataFrame:
    """qid, question, source, split, solution, ground_truth, features, rubric_features: a row for each query of the JSON maps in ``text``.

    ``solution`` is JSON text, ``ground_truth`` a map of texts. Where a query has a solution, that is its ground truth. A text that isn't a JSON map has no queries.
    """
    entry = "struct<query:string,source:string,split:string,solution:string,ground_truth:map<string,string>,features:array<string>,rubric_features:array<string>>"
    each = pool.select(F.explode(F.from_json(text, f"map<string,{entry}>")).alias("qid", "q"))
    truth = F.when(F.col("q.solution").isNull(), F.col("q.ground_truth")).otherwise(F.create_map(F.lit("dataset"), F.lit("semgir"), F.lit("semgir_json"), F.col("q.solution")))
    return each.select("qid", F.trim("q.query").alias("question"), "q.source", "q.split", "q.solution", truth.alias("ground_truth"), "q.features", "q.rubric_features")
