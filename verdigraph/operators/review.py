"""The review of judged answers: pooled answers with what their judges say, decisions filled in and checked, and where to go on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.text import CATEGORIES
from verdigraph.operators.answers import seeded
from verdigraph.operators.runs import placed
from verdigraph.plans.skew import running_total


def badge(judges: Column) -> Column:
    """correct, wrong or mixed for the set of an answer's judgements."""
    return F.when(F.size(judges) != 1, "mixed").when(judges[0], "correct").otherwise("wrong")


def pooled(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, output_key, runs, judges, badge, categories, suggestion, rationales, first, place: a row for each answer of a question.

    ``groups`` has keys, output_key, position, model, size, correct, category and rationale, a row for each group of one model. ``judges`` is the sorted set of judgements, ``categories``
    that of the categories they name, ``suggestion`` the known category of the largest group that has one (the first of equal ones), ``rationales`` a list of each
    rationale with the models it was given for. ``place`` numbers a question's answers by their runs, equal ones by their first group. Missing rationales and categories are empty.
    """
    own = groups.withColumn("rationale", F.coalesce("rationale", F.lit(""))).withColumn("category", F.coalesce("category", F.lit("")))
    said = own.groupBy(*keys, "output_key", "rationale").agg(F.array_sort(F.collect_set("model")).alias("models"))
    said = said.groupBy(*keys, "output_key").agg(F.array_sort(F.collect_list(F.struct("rationale", "models"))).alias("rationales"))
    known = F.when(F.col("category").isin(*CATEGORIES), F.struct(F.col("size"), (-F.col("position")).alias("at")))
    named = F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category"))))
    totals = [F.sum("size").alias("runs"), F.array_sort(F.collect_set("correct")).alias("judges"), named.alias("categories"), F.max_by("category", known).alias("suggestion"), F.min("position").alias("first")]
    each = own.groupBy(*keys, "output_key").agg(*totals).join(said, [*keys, "output_key"]).withColumn("badge", badge(F.col("judges")))
    return placed(each, keys, "runs", F.col("first"), F.col("output_key"))


def accept_judge(answers: DataFrame) -> DataFrame:
    """``answers(verdict, judges)`` where an open verdict is the judges' if they agree."""
    agreed = F.when(F.size("judges") == 1, F.get("judges", F.lit(0)))
    return answers.withColumn("verdict", F.coalesce("verdict", agreed))


def problems(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, place, problem: answers without a verdict, and those against the judges without a reason."""
    against = F.coalesce(F.col("judges") != F.array("verdict"), F.lit(True)) & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    problem = F.when(F.col("verdict").isNull(), "no verdict").when(against, "no reason")
    return answers.select(*keys, "place", problem.alias("problem")).filter("problem IS NOT NULL")


def discrepancies(answers: DataFrame) -> DataFrame:
    """``answers`` with ``discrepancy``: whether the verdict isn't what all judges say. Open ones have none."""
    return answers.withColumn("discrepancy", F.when(F.col("verdict").isNotNull(), F.col("judges") != F.array("verdict")))


def next_open(queries: DataFrame, current: str | None) -> DataFrame:
    """qid of the first query of ``queries(position, qid, done)`` that isn't done, from the one after ``current`` on and then from the start; no row if all are done."""
    at = queries.filter(F.col("qid") == current).agg(F.max("position").alias("_at")).withColumn("_one", F.lit(1))
    from_here = queries.withColumn("_one", F.lit(1)).join(F.broadcast(at), "_one")
    behind = F.col("position") > F.coalesce("_at", F.lit(-1))
    return from_here.filter("NOT done").orderBy(F.desc(behind), "position").limit(1).select("qid")


def marks(runs: DataFrame) -> DataFrame:
    """qid, output, correct, size, first for ``runs(qid, position, output, correct)``: what a query's distinct outputs were judged, by their first runs."""
    return runs.groupBy("qid", "output", "correct").agg(F.count("*").alias("size"), F.min("position").alias("first"))


def rarest_tag_split(pool: DataFrame, fraction: float, seed: int) -> DataFrame:
    """qid, tag, split of ``pool(qid, tags)``: each query's rarest tag (of equal ones the first in its list), and val or train.

    Of the queries with one rarest tag the share ``fraction`` goes to val, rounded, by a random order that any engine can repeat; then others by that order until val has
    its share of all. A query without tags has none and only fills up. Queries are ranked by leading digits of the order first, so no tag meets in one task.
    """
    each = pool.select("qid", F.posexplode_outer("tags").alias("at", "tag"))
    counts = each.groupBy("tag").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "tag", "left").groupBy("qid").agg(F.min_by("tag", F.struct("n", "at")).alias("tag"))
    rows = rarest.withColumn("_order", seeded(seed, "qid")).withColumn("_bucket", F.substring("_order", 1, 3)).withColumn("_one", F.lit(1))
    ranked = running_total(rows.filter("tag IS NOT NULL"), "tag", "_bucket", [F.col("_order"), F.col("qid")], "_one", "_before")
    sizes = rows.groupBy("tag").agg(F.count("*").alias("_n"))
    share = lambda n: F.bround(F.col(n) * F.lit(fraction), 0)
    taken = ranked.join(sizes, "tag").filter(F.col("_before") < share("_n")).select("qid", F.lit(1).alias("_taken"))
    known = rows.join(taken, "qid", "left").withColumn("_open", F.when(F.col("_taken").isNull(), 1).otherwise(0)).withColumn("_all", F.lit(1))
    filled = running_total(known, "_all", "_bucket", [F.col("_order"), F.col("qid")], "_open", "_place")
    # One row: how many are still needed.
    need = known.agg((F.bround(F.count("*") * F.lit(fraction), 0) - F.coalesce(F.sum("_taken"), F.lit(0))).alias("_need")).withColumn("_all", F.lit(1))
    val = F.col("_taken").isNotNull() | (F.col("_place") < F.col("_need"))
    return filled.join(F.broadcast(need), "_all").select("qid", "tag", F.when(val, "val").otherwise("train").alias("split"))
