"""Slice-wise ordered passes against plain Python on one sequence at a time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators.investigation import bounded_examples
from tandemtape.operators.ordered import carry, haloed, longest_run, sliced


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for key in ("a", "b", "c"):
        at = 0
        for _ in range(60 if key == "a" else 7):
            at += rng.choice([1, 1, 2, 30])
            out.append((key, at, rng.choice([None, rng.randint(0, 9)])))
    return out


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_carry_matches_plain_python(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, p long, v int").repartition(5)
    placed, track = sliced(df, ["k"], ["p"], "p", size)
    v = F.col("v")
    got = carry(
        placed, track, before={"prev": v, "prev_some": (v, v.isNotNull())}, upto={"last_some": (v, v.isNotNull())},
        after={"next_big": (v, v > 5)}, sums={"running": v}, totals={"total": v},
    ).collect()
    for key in "abc":
        seq = sorted((p, v) for k, p, v in rows if k == key)
        mine = {r.p: r for r in got if r.k == key}
        for i, (p, value) in enumerate(seq):
            r, past, later = mine[p], [x for _, x in seq[:i]], [x for _, x in seq[i + 1:]]
            some = [x for x in past if x is not None]
            assert r.prev == (past[-1] if past else None)
            assert r.prev_some == (some[-1] if some else None)
            assert r.last_some == (value if value is not None else r.prev_some)
            assert r.next_big == next((x for x in later if x is not None and x > 5), None)
            assert (r.running or 0) == sum(x for x in [*past, value] if x is not None)
            assert (r.total or 0) == sum(x for _, x in seq if x is not None)


@pytest.mark.parametrize("size", [2, 7, 1000])
def test_halo_sees_neighbours_across_slices(spark, size):
    df = spark.createDataFrame([("x", i) for i in range(40)], "k string, p long")
    halo, track = haloed(df, ["k"], "p", back=3, ahead=2, size=size)
    w = track.window()
    got = halo.withColumn("b", F.lag("p", 3).over(w)).withColumn("a", F.lead("p", 2).over(w)).where("_own").collect()
    assert len(got) == 40
    for r in got:
        assert r.b == (r.p - 3 if r.p >= 3 else None)
        assert r.a == (r.p + 2 if r.p <= 37 else None)


def test_longest_run_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("x", 2, 5), ("x", 2, 6), ("x", 3, 9)], "k string, run int, p int")
    r = longest_run(df, ["k"], "run", "p").collect()[0]
    assert (r.run, r.run_length, r.run_start, r.run_end) == (1, 2, 1, 2)


def test_quantiles_with_hot_value_outliers_and_signs(spark):
    rng = random.Random(3)
    values = [0.0] * 500 + [rng.gauss(0, 1) for _ in range(700)] + [1e12, -1e12, 1e-300, -1e-300] + [50_000 + rng.random() * 1e-6 for _ in range(300)]
    small = [2.5, 1.5]
    df = spark.createDataFrame([("hot", v) for v in values] + [("two", v) for v in small] + [("two", None)], "k string, v double")
    picks = {"mid": ("linear", 0.5), "near": ("nearest", 0.95), "even": ("round_even", 0.25), "up": ("ceil", 0.99)}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", picks).collect()}
    import math

    for key, data in (("hot", sorted(values)), ("two", sorted(small))):
        n, r = len(data), got[key]
        at = (n - 1) * 0.5
        assert r.n == n
        assert r.mid == pytest.approx((data[math.floor(at)] + data[math.ceil(at)]) / 2, abs=0)
        assert r.near == data[math.floor((n - 1) * 0.95 + 0.5)]
        assert r.even == data[round((n - 1) * 0.25)]
        assert r.up == data[math.ceil((n - 1) * 0.99)]


def test_weighted_quantile_counts_each_weight(spark):
    df = spark.createDataFrame([("k", 1.0, 5), ("k", 9.0, 4)], "k string, v double, w long")
    r = exact_quantiles(df, ["k"], "v", {"m": ("linear", 0.5)}, weight="w").collect()[0]
    assert (r.n, r.m) == (9, 1.0)


def test_first_rows_over_small_slices(spark):
    df = spark.createDataFrame([("k", i * 3) for i in range(100)], "k string, p long")
    got = bounded_examples(df, ["k"], "p", first=7, size=8).collect()
    assert sorted((r.p, r.place) for r in got) == [(i * 3, i + 1) for i in range(7)]
