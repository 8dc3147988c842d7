"""The chi-square tail of large families against sums in long decimals."""

from __future__ import annotations

from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tandemtape.functions import tails


def tail(half: float, pairs: int) -> float:
    """The finite Poisson sum in 50 digits."""
    with localcontext() as c:
        c.prec = 50
        x, term, total = Decimal(half), (-Decimal(half)).exp(), Decimal(0)
        for i in range(pairs):
            total += term
            term = term * x / (i + 1)
        return float(total)


CASES = [(0.5, 1), (3.0, 2), (70.0, 64), (64.5, 65), (65.0, 65), (40.0, 65), (150.0, 65), (1000.0, 1000), (900.0, 1000), (1250.0, 1000), (20_000.0, 20_000), (20_600.0, 20_000), (19_300.0, 20_000), (101_500.0, 100_000)]


def test_tail_agrees_to_twelve_digits(spark):
    df = spark.createDataFrame([(2 * half, 2 * pairs) for half, pairs in CASES], "x double, df long")
    got = {(r.x, r.df): r.p for r in df.select("x", "df", tails.chi2_tail_even(F.col("x"), F.col("df")).alias("p")).collect()}
    for half, pairs in CASES:
        assert got[2 * half, 2 * pairs] == pytest.approx(tail(half, pairs), rel=2e-12, abs=2e-13)


def test_ends_of_the_range(spark):
    df = spark.createDataFrame([(0.0, 200), (float("inf"), 200), (1e7, 200), (1e-9, 200000)], "x double, df long")
    assert [r[0] for r in df.select(tails.chi2_tail_even(F.col("x"), F.col("df"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_a_million_values_in_one_family(spark):
    """Even p-values of (i + 0.5) / n give a statistic close to its mean, so a tail near one half."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("all").alias("family"), ((F.col("id") + 0.5) / n).alias("p"))
    summed = df.groupBy("family").agg((-2 * F.sum(F.ln("p"))).alias("x"), (2 * F.count("p")).alias("df"))
    p = summed.select(tails.chi2_tail_even(F.col("x"), F.col("df")).alias("p")).first().p
    assert 0.49 < p < 0.52
