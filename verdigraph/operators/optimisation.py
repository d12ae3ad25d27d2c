"""Tables of a prompt-optimisation loop: results for each query, the verdict cache, the log of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8


def query_results(verdicts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """qid, n, rate, passed, error, rationale, judge_failed, n_outputs for ``verdicts(qid, position, output, correct, category, rationale, judge_failed)``.

    ``error`` is the most frequent category among answers that were judged wrong, the one seen first on ties; ``rationale`` is its first. A query of
    which every judgement failed counts as failed by the judge.
    """
    judged = F.coalesce("correct", F.lit(False))
    wrong = verdicts.filter(~judged & ~F.coalesce("judge_failed", F.lit(False)) & (F.coalesce("category", F.lit("")) != ""))
    errors = wrong.groupBy("qid", "category").agg(F.count("*").alias("n"), F.min(F.struct("position", "rationale")).alias("first"))
    worst = errors.groupBy("qid").agg(F.max_by(F.struct("category", "first.rationale"), F.struct(F.col("n"), -F.col("first.position"))).alias("top"))
    each = verdicts.groupBy("qid").agg(F.count("*").alias("n"), F.avg(judged.cast("int")).alias("rate"), F.bool_or("judge_failed").alias("judge_failed"), F.count_distinct("output").alias("n_outputs"))
    met = each.join(worst, "qid", "left").withColumn("passed", F.col("rate") >= threshold)
    return met.select("qid", "n", "rate", "passed", F.col("top.category").alias("error"), F.col("top.rationale").alias("rationale"), F.coalesce("judge_failed", F.lit(False)).alias("judge_failed"), "n_outputs")


def failing(results: DataFrame, split: str = "train") -> DataFrame:
    """The queries of a split to learn from: not passed, and not for the judge's fault."""
    return results.filter((F.col("split") == split) & ~F.col("passed") & ~F.col("judge_failed"))


def by_category(failures: DataFrame) -> DataFrame:
    """error, n, qids: failures by category, the largest first, equal ones by name."""
    return failures.groupBy("error").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("qid")).alias("qids")).orderBy(F.desc("n"), "error")


def transitions(champion: DataFrame, candidate: DataFrame) -> DataFrame:
    """qid, before, after of the queries that both have results for."""
    return champion.select("qid", F.col("passed").alias("before")).join(candidate.select("qid", F.col("passed").alias("after")), "qid")


def net_gain(changes: DataFrame) -> DataFrame:
    """One row: fixed, broken and their difference, 0 without changes."""
    fixed, broken = F.count_if(~F.col("before") & F.col("after")), F.count_if(F.col("before") & ~F.col("after"))
    return changes.agg(fixed.alias("fixed"), broken.alias("broken"), (fixed - broken).alias("net"))


def regressions(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("before") & ~F.col("after"))


def mean_rate(results: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: the mean rate of the queries in ``ids(qid)``, 0 if none has a result."""
    return results.join(ids.select("qid").distinct(), "qid", "left_semi").agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("mean_rate"))


def all_pass(results: DataFrame) -> DataFrame:
    """One row: whether every query passes; true of none."""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_pass"))


def valid_cache(cache: DataFrame, truths: DataFrame) -> DataFrame:
    """The cached verdicts whose ground truth is still the same, by ``truths(qid, truth_hash)``."""
    return cache.join(truths.select("qid", "truth_hash").distinct(), ["qid", "truth_hash"], "left_semi")


def merged_cache(cache: DataFrame, current: DataFrame, keys: Sequence[str] = ("qid", "output")) -> DataFrame:
    """Cached verdicts and current ones, of which those that a judge didn't fail on replace cached ones of the same key; null keys match each other."""
    lasting = current.filter(~F.coalesce("judge_failed", F.lit(False))).select(*cache.columns)
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    return cache.alias("c").join(lasting.alias("n"), same, "left_anti").unionByName(lasting)


def last_rejected(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rejected iterations, in order."""
    return log.filter("status = 'rejected'").orderBy(F.desc("iteration")).limit(n).orderBy("iteration")


def rejected_since_kept(log: DataFrame) -> DataFrame:
    """Rejected iterations after the last that was kept; all of them if none was."""
    last = log.filter("status = 'kept'").agg(F.coalesce(F.max("iteration"), F.lit(-1)).alias("last"))
    # One row.
    return log.join(F.broadcast(last), (F.col("status") == "rejected") & (F.col("iteration") > F.col("last"))).drop("last")
