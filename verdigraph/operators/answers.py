"""Grouping, deduplication, sampling and anti-joins of questions and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_answers(df: DataFrame, keys: Sequence[str], normal: Column, position: str) -> DataFrame:
    """keys, answer, size, first_pos, runs: equal normal forms as one group; the first row stands for it, its runs are sorted."""
    return df.withColumn("answer", normal).groupBy(*keys, "answer").agg(F.count("*").alias("size"), F.min(position).alias("first_pos"), F.array_sort(F.collect_list(position)).alias("runs"))


def seeded(seed: int, *columns: str) -> Column:
    """A random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def one_per(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """The first row by ``order`` for each non-null key. Only one candidate a task and key is shuffled."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(best.alias("_row")).select("_row.*")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, seed: int, ident: str) -> DataFrame:
    """n rows, each stratum in proportion but with one at least; all rows if there are no more. Null strata are left out of the quotas, and fill up."""
    order = seeded(seed, ident)
    known = df.withColumn("_order", order)
    total = known.count()
    if n >= total:
        return df
    sizes = known.dropna(subset=list(strata)).groupBy(*strata).agg(F.count("*").alias("_size"))
    quota = F.greatest(F.lit(1), F.least(F.col("_size"), F.bround(F.col("_size") * F.lit(n) / F.lit(total), 0).cast("long")))
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_order", ident)))
    # No row behind the first n of its stratum is ever taken, so tasks keep no more than these.
    taken = ranked.filter(F.col("_rank") <= n).join(sizes.withColumn("_quota", quota), list(strata), "left").withColumn("_first", F.coalesce(F.col("_rank") <= F.col("_quota"), F.lit(False)))
    return taken.orderBy(F.desc("_first"), "_order", ident).limit(n).select(*df.columns)


def anti_join(df: DataFrame, others: DataFrame, left: Column, right: Column) -> DataFrame:
    return df.withColumn("_key", left).join(others.select(right.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The state that an append log leads to: the last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; the one seen first wins ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_v")).select(*keys, "_v.*")
