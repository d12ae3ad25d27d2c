"""Pass rates and paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The chance that k of n attempts, drawn without replacement, hold one of c correct ones: 0 without any, 1 where fewer than k are wrong."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def pass_power_k(n: Column, c: Column, k: int) -> Column:
    """The chance that k attempts drawn with replacement are all correct."""
    return F.when(n == 0, 0.0).otherwise(F.pow(c / n, F.lit(float(k))))


def mcnemar_statistic(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1.0, F.lit(2.0)) / (b + c))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > x)."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


def wilcoxon_p(w: float, n: int, tie_term: float, exact: bool) -> float:
    """Two-sided p of the smaller rank sum: counted exactly for few untied differences, else by the normal curve with the correction for ties."""
    if n == 0:
        return 1.0
    if exact:
        ways = [1]
        for r in range(1, n + 1):
            longer = ways + [0] * r
            for i, x in enumerate(ways):
                longer[i + r] += x
            ways = longer
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(w - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
