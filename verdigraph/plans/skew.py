"""Joins and running totals that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut

#: Most rows that ``repeated`` makes of one row in one step.
STEP = 65_536


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join of a large ``left`` to a ``right`` with one row for each key.

    A hot key of ``left`` is dealt to ``salts`` tasks by the hash of ``by``; ``right`` is repeated that often, so it should be the small side.
    Keys must not be null.
    """
    many = left.withColumn("_salt", F.pmod(F.hash(by), F.lit(salts)))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(each, [*keys, "_salt"], how).drop("_salt")


def _many_tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def pairs_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Column, salts: int = 64) -> DataFrame:
    """Equi-join of which the pairs of one key are many more than its rows.

    Each key of ``left`` is dealt to ``salts`` parts by the hash of ``by`` and ``right`` is repeated that often. The number of tasks is fixed, as few rows come in and many go out,
    and adaptive execution would put small parts together. Keys must not be null.
    """
    tasks = _many_tasks(left)
    many = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).repartition(tasks, *keys, "_salt")
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(tasks, *keys, "_salt")
    return many.join(each, [*keys, "_salt"]).drop("_salt")


def running_total(df: DataFrame, key: str, bucket: str, order: Sequence[Column], value: str, to: str) -> DataFrame:
    """Adds ``to``: the sum of ``value`` over the rows of the same ``key`` that stand before this one by (bucket, order).

    Two levels: totals of the buckets run over few rows for each key, then each bucket runs on its own, so a key with most of the rows is split by bucket.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(bases, [key, bucket]).withColumn(to, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def count_passed(left: DataFrame, right: DataFrame, key: str, value: str, operator: str, to: str) -> DataFrame:
    """key, value, ``to``: for each pair of these in ``left`` how many rows of ``right`` with the same key have a value that is ``operator`` (<, <=, > or >=) that of ``left``.

    Pairs without such rows, and nulls, are left out. Nothing is joined: equal values are counted once, all values are dealt by ranges, and the counts are running totals,
    so the work is that of sorting both sides, whatever the number of pairs.
    """
    up = operator[0] == "<"
    side = lambda df, n: df.select(key, value, F.lit(n).cast("long").alias("_n"), F.lit(1 - n).alias("_asked"))
    values = side(left, 0).unionByName(side(right, 1)).dropna(subset=[key, value]).groupBy(key, value).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    place = F.spark_partition_id()
    # Written, as another run of this could draw other ranges.
    dealt = cut(values.repartitionByRange(_many_tasks(left), key, value).withColumn("_part", place if up else -place), "values")
    total = running_total(dealt, key, "_part", [F.asc(value) if up else F.desc(value)], "_n", "_before")
    found = F.col("_before") + (F.col("_n") if operator.endswith("=") else F.lit(0))
    return total.filter("_asked = 1").select(key, value, found.alias(to)).filter(F.col(to) > 0)


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its ``times`` says, which is dropped. Rows are dealt anew before they are many, in steps of at most STEP, so that one with a high number is the work of many tasks."""
    rest = [c for c in df.columns if c != times]
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {STEP}")))
    steps = df.filter(F.col(times) > 0).select("*", first.alias("_step")).select(*rest, F.least(F.col(times) - F.col("_step") * STEP, F.lit(STEP)).cast("int").alias("_rows"))
    return steps.repartition(_many_tasks(df)).select(*rest, F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row")).drop("_row")


#: Most keys that hub_join broadcasts, and the fewest rows of a key that is a hub; a few times as many rows in all need no such care.
HUBS = 50_000
LEAST = 500


def hub_join(left: DataFrame, right: DataFrame, key: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner equi-join of ``left`` to ``right``, which has one row for each key and in ``count`` how many rows of ``left`` have it.

    ``total`` is at least the sum of ``count``. Keys with at least total / HUBS rows are hubs: there can't be more than HUBS of them, so they
    are broadcast and their rows stay where they are. Only rows of other keys are shuffled. Keys must not be null.
    """
    if total < 4 * LEAST:
        return left.join(right, list(key))
    least = max(LEAST, -(-total // HUBS))
    hubs = right.filter(F.col(count) >= least)
    met = left.join(F.broadcast(hubs), list(key))
    rest = left.join(F.broadcast(hubs.select(*key)), list(key), "left_anti").join(right.filter(F.col(count) < least), list(key))
    return met.unionByName(rest)
