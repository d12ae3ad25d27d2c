"""Metrics of reviewed answer groups: pass rates for each query, summaries for each model, error shares and paired tests."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.functions import stats, text

KEYS = ("grammar", "model", "qid")
RATES = ("success_rate", "hypothesis_coverage")
COSTS = ("inference_time", "completion_tokens")
SOLVED, SIGNIFICANT, EXACT_UP_TO = 0.99, 0.05, 50


def _size(df: DataFrame) -> DataFrame:
    """``group_size`` as a number, 0 if it isn't one; thinking models under a name of their own."""
    thinking = F.coalesce(text.truthy(F.col("thinking").cast("string")), F.lit(False))
    size = F.coalesce(F.col("group_size").try_cast("long"), F.lit(0).cast("long"))
    return df.withColumns({"group_size": size, "thinking": thinking, "correct": F.coalesce(text.truthy(F.col("human_correct").cast("string")), F.lit(False))}).withColumn(
        "model", F.when(F.col("thinking"), F.concat("model", F.lit(" (Thinking)"))).otherwise(F.col("model"))
    )


def query_metrics(reviewed: DataFrame, summaries: DataFrame, truths: DataFrame, ks: Sequence[int]) -> DataFrame:
    """grammar, model, qid, n, c, success_rate, hypothesis_coverage, inference_time, completion_tokens, pass_at_<k> and pass_pow_<k>: a row for each query.

    ``reviewed(grammar, model, thinking, qid, group_size, human_correct, hypotheses)`` has a row for each answer group; sizes are summed, so a query without
    runs is left out. ``truths(qid, n_readings)`` says how many readings could be covered, 1 where a query isn't known. Times and tokens come from
    ``summaries(grammar, model, thinking, qid, inference_time, completion_tokens)`` and are 0 where there is none; nulls of the keys match each other.
    """
    groups = _size(reviewed)
    h = F.coalesce(F.col("hypotheses").try_cast("double"), F.lit(0.0))
    when = lambda c: F.coalesce(F.sum(F.when(F.col("correct"), c)), F.lit(0))
    each = groups.groupBy(*KEYS).agg(F.sum("group_size").alias("n"), when(F.col("group_size")).alias("c"), when(h * F.col("group_size")).alias("covered")).filter("n > 0")
    known = _size(summaries.withColumns({"group_size": F.lit(0), "human_correct": F.lit("")})).groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in COSTS])
    met = each.alias("e").join(known.alias("s"), _same("e", "s", KEYS), "left")
    met = met.select("e.*", *[F.coalesce(f"s.{c}", F.lit(0.0)).cast("double").alias(c) for c in COSTS])
    met = met.join(truths.select("qid", "n_readings"), "qid", "left")
    possible = F.col("n") * F.coalesce("n_readings", F.lit(1))
    rates = {"success_rate": F.col("c") / F.col("n"), "hypothesis_coverage": F.when(possible > 0, F.col("covered") / possible).otherwise(0.0)}
    at = {name: f(F.col("n"), F.col("c"), k) for k in ks for name, f in ((f"pass_at_{k}", stats.pass_at_k), (f"pass_pow_{k}", stats.pass_power_k))}
    return met.withColumns(rates | at).select(*KEYS, "n", "c", *RATES, *COSTS, *at)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def model_summary(metrics: DataFrame) -> DataFrame:
    """The mean over queries of every measure for each grammar and model, as avg_* for rates and costs."""
    measures = [c for c in metrics.columns if c not in (*KEYS, "n", "c")]
    return metrics.groupBy("grammar", "model").agg(*[F.avg(c).alias(f"avg_{c}" if c in RATES + COSTS else c) for c in measures])


def formatted(summary: DataFrame) -> DataFrame:
    """Measures as text: times and tokens with two places, all others with four; halves go to the even digit."""
    places = {c: 2 if c.removeprefix("avg_") in COSTS else 4 for c in summary.columns if c not in KEYS}
    return summary.withColumns({c: F.format_string(f"%.{n}f", F.bround(c, n)) for c, n in places.items()})


def error_shares(reviewed: DataFrame) -> DataFrame:
    """grammar, model, category, count, percentage of the wrong answers' categories; wrong answers without a category don't count."""
    wrong = _size(reviewed).filter(~F.col("correct") & (F.coalesce("category", F.lit("")) != ""))
    counts = wrong.groupBy("grammar", "model", "category").agg(F.sum("group_size").alias("count"))
    total = F.sum("count").over(Window.partitionBy("grammar", "model"))
    return counts.withColumn("percentage", F.bround(100 * F.col("count") / total, 2))


def baseline_pairs(metrics: DataFrame, baseline: str) -> DataFrame:
    """model, grammar, qid, base and other (structs of the measures): each query of the baseline grammar, named in any case, beside each other grammar's."""
    measures = F.struct(*[c for c in metrics.columns if c not in KEYS])
    is_base = F.lower("grammar") == baseline.lower()
    base = metrics.filter(is_base).select("model", "qid", measures.alias("base"))
    return metrics.filter(~is_base).select("model", "qid", "grammar", measures.alias("other")).join(base, ["model", "qid"])


def paired_tests(metrics: DataFrame, baseline: str, ks: Sequence[int]) -> DataFrame:
    """model, grammar, metric, test, statistic, n, p, significant: McNemar on queries solved at the largest k, Wilcoxon on all other rates.

    A query counts as solved from SOLVED on. Differences of 0 are left out of Wilcoxon's ranks; p is counted exactly up to EXACT_UP_TO differences
    without ties and zeros. ``p`` is rounded, ``significant`` goes by the full value. Only counts of distinct differences are ranked.
    """
    pairs = baseline_pairs(metrics, baseline)
    top = f"pass_at_{max(ks)}"
    solved = pairs.withColumns({"x": F.col(f"base.{top}") >= SOLVED, "y": F.col(f"other.{top}") >= SOLVED}).groupBy("model", "grammar")
    counts = solved.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"), F.count("*").alias("n"))
    chi = stats.mcnemar_statistic(F.col("b"), F.col("c"))
    mcnemar = counts.select("model", "grammar", F.lit(top).alias("metric"), F.lit("McNemar").alias("test"), chi.alias("statistic"), "n", F.when(F.col("b") + F.col("c") == 0, 1.0).otherwise(stats.chi_square_tail(chi)).alias("p"))
    names = [*RATES, *[f"pass_pow_{k}" for k in ks]]
    each = pairs.select("model", "grammar", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"base.{m}") - F.col(f"other.{m}")).alias("d")) for m in names])))
    group = ["model", "grammar", "metric"]
    # Rounded so that equal differences of rates are equal numbers.
    sizes = each.withColumn("d", F.round("d", 12)).groupBy(*group, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.filter("size > 0").withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("up"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("down"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"))
    zeros = sizes.groupBy(*group).agg(F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    joined = zeros.join(sums, group, "left").fillna(0, ["n", "up", "down", "ties"])
    w = F.least("up", "down").cast("double")
    exact = (F.col("n") <= EXACT_UP_TO) & (F.col("ties") == 0) & (F.col("zeros") == 0)

    def tail(w: pd.Series, n: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([stats.wilcoxon_p(*row) for row in zip(w, n, ties, exact, strict=True)], dtype=float)

    p = F.pandas_udf(tail, "double")(w, F.col("n"), F.col("ties"), exact)
    wilcoxon = joined.select(*group, F.lit("Wilcoxon").alias("test"), w.alias("statistic"), "n", p.alias("p"))
    return mcnemar.unionByName(wilcoxon).withColumn("significant", F.col("p") < SIGNIFICANT).withColumn("p", F.round("p", 4))


def two_measures(counts: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """keys and, for each of ``categories``, ``<category>_count`` and ``<category>_percentage`` of the key's total, for ``counts(keys, category, count)``; 0 where there is none."""
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"), *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("count"))), F.lit(0)).alias(f"{c}_count") for c in categories])
    share = lambda c: F.coalesce(F.bround(F.lit(100.0) * F.col(f"{c}_count") / F.nullif(F.col("_total"), F.lit(0)), 2), F.lit(0.0)).alias(f"{c}_percentage")
    return totals.select(*keys, *[x for c in categories for x in (F.col(f"{c}_count"), share(c))])
