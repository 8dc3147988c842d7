"""Distribution tails that Spark has no built-in for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf_value(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return value


def f_tail_value(f: float, d1: float, d2: float) -> float:
    """P(F(d1, d2) > f)."""
    if not math.isfinite(f) or f <= 0:
        return 1.0 if f <= 0 else float("nan")
    a, b, x = d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided_value(v))


#: Up to this many pairs of degrees the tail is the whole finite sum; beyond, a sum of some nine square roots of them.
WHOLE_SUM = 64


def chi2_tail_even(x: Column, df: Column) -> Column:
    """P(chi2(df) > x) for even df."""
    half, pairs = x / 2, (df / 2).cast("bigint")
    tail = F.when(pairs <= WHOLE_SUM, _poisson_sum(half, pairs)).otherwise(_near_the_top(half, pairs))
    return F.when(x == float("inf"), F.lit(0.0)).when(x == 0, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def _poisson_sum(half: Column, pairs: Column) -> Column:
    """All terms, each from its logarithm so none overflows."""
    start = F.struct((-half).alias("log_term"), F.exp(-half).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["log_term"] + F.ln(half) - F.ln(i.cast("double"))
        return F.struct(term.alias("log_term"), (state["total"] + F.exp(term)).alias("total"))

    more = F.when(pairs > 1, F.sequence(F.lit(1).cast("bigint"), pairs - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, start, add, lambda s: s["total"])


def _near_the_top(half: Column, pairs: Column) -> Column:
    """The incomplete gamma function as a sum of falling positive terms, from the largest one on.

    Above the mean these are the Poisson terms downwards, below it the series of the other tail.  After j terms they have
    fallen to about exp(-j^2 / 2n), so nine square roots of n reach double precision whatever n is.
    The largest term comes from the deviation of ``half`` from the mean, which cancels nothing, and from Stirling's series.
    """
    n = pairs.cast("double")
    away = (half - n) / n
    stirling = 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    peak = F.exp(-n * (away - F.log1p(away)) - stirling) / F.sqrt(2 * math.pi * n)
    above = half > n
    steps = F.ceil(9 * F.sqrt(F.greatest(half, n))) + 40
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] * F.when(above, F.greatest(n - j, F.lit(0.0)) / half).otherwise(half / (n + j))
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), start, add, lambda s: s["total"])
    return F.when(above, peak * n / half * total).otherwise(1 - peak * total)
