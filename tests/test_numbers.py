"""Derived decimals against Python's decimals at any size."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tandemtape.functions import numbers as N
from tandemtape.operators import normalize
from tandemtape.schemas import STORED

UNIT = Decimal("1e-18")
LIMIT = Decimal(10) ** 20


def expected(kind: str, a: Decimal, b: Decimal) -> Decimal | None:
    with localcontext() as c:
        c.prec = 140
        value = {"total": a + b, "difference": a - b, "midpoint": (a + b) / 2, "product": a * b, "ratio": a / b if b else None}[kind]
        return None if value is None else value.quantize(UNIT, rounding=ROUND_HALF_EVEN)


def numbers(count: int) -> list[tuple[Decimal, Decimal]]:
    r = random.Random(11)

    def one() -> Decimal:
        digits = r.choice([1, 5, 17, 18, 19, 20, 28, 29, 30, 36, 37, 38])
        if r.random() < 0.4:  # What the generated code takes: nine places at most.
            return (Decimal(r.choice([-1, 1]) * r.choice([r.randrange(10 ** r.choice([4, 12, 18])), 10**18 - 1, 900_000 * 10**9, 1])).scaleb(-9)).quantize(UNIT)
        value = r.choice([r.randrange(10**digits), 10**digits - 1, 10 ** (digits - 1), 5 * 10 ** (digits - 1)])
        return Decimal(r.choice([-1, 1]) * value).scaleb(-18)

    with localcontext() as c:
        c.prec = 60
        return [(one(), one()) for _ in range(count)]


HAND = [("0.000000000123456789", "1000.5"), ("1.0000000004", "1.0000000006"), ("12345678901.5", "12345678901.25"), ("0.000000000000000001", "0.5"),
        ("0.000000000000000003", "0.5"), ("99999999999999999999.999999999999999999", "0.000000000000000001"), ("1", "3"), ("-2", "3"), ("99999999999999999999", "99999999999999999998"),
        ("60000000000", "70000000000.000000000000000001"), ("0", "5"), ("5", "0"), ("0.000000000000000001", "0.000000000000000002")]


@pytest.mark.parametrize("kind", ["total", "difference", "midpoint", "product", "ratio"])
def test_derived_values_are_exact(spark, kind):
    pairs = [(Decimal(a), Decimal(b)) for a, b in HAND] + numbers(400)
    cases = {}
    for a, b in pairs:
        value = expected(kind, a, b)
        if value is None or -LIMIT < value < LIMIT:
            cases[a, b] = value
    assert len(cases) > 200
    df = spark.createDataFrame([(str(a), str(b)) for a, b in cases], "a string, b string")
    got = df.select("a", "b", getattr(N, kind)(F.col("a").cast(STORED), F.col("b").cast(STORED)).alias("r"))
    assert got.schema["r"].dataType.simpleString() == STORED
    assert {(Decimal(r.a), Decimal(r.b)): r.r for r in got.collect()} == cases


@pytest.mark.parametrize("kind,a,b", [("product", "10000000000", "10000000000"), ("total", "99999999999999999999", "1"), ("ratio", "100", "0.000000000000000001"), ("ratio", "99999999999999999999", "0.5"), ("product", "99999999999999999999", "99999999999999999999")])
def test_only_a_result_that_does_not_fit_stops_the_job(spark, kind, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    with pytest.raises(Exception, match="does not fit|OUT_OF_RANGE"):
        df.select(getattr(N, kind)(F.col("a").cast(STORED), F.col("b").cast(STORED))).collect()


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, None)], "a string, b string").select(F.col("a").cast(STORED).alias("a"), F.col("b").cast(STORED).alias("b"))
    for kind in (N.total, N.difference, N.midpoint, N.product, N.ratio):
        assert [r[0] for r in df.select(kind(F.col("a"), F.col("b"))).collect()] == [None] * 3


def test_quote_measures_keep_all_places(spark):
    df = spark.createDataFrame([("1.0000000004", "3", "1.0000000006", "0"), ("12345678901.5", "0", "12345678901.500000000000000001", "0")], "b string, bs string, a string, az string")
    rows = normalize.quote_measures(df.select(*[F.col(c).cast(STORED).alias(c) for c in df.columns]), "b", "bs", "a", "az").collect()
    assert rows[0].spread == Decimal("2e-10") and rows[0].midprice == Decimal("1.0000000005") and rows[0].bid_ask_imbalance == 1
    assert rows[0].relative_spread == expected("ratio", Decimal("2e-10"), Decimal("1.0000000005")) and rows[0].spread_basis_points == rows[0].relative_spread * 10000
    # Half of the last place goes to the even neighbour.
    assert rows[1].spread == UNIT and rows[1].midprice == Decimal("12345678901.5") and rows[1].bid_ask_imbalance is None and not rows[1].locked_market_indicator
