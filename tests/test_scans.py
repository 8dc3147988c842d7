"""Counted slices and the tree of scans against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tandemtape.operators import investigation
from tandemtape.operators.scans import counted_slices, scan
from tandemtape.session import cut


def sequences(kind: str) -> list[tuple]:
    r = random.Random(4)
    if kind == "far apart":
        places = {"a": [i * 10**9 + r.randrange(100) for i in range(300)], None: [-5 * 10**17, 4 * 10**18]}
    elif kind == "one dense hour":
        places = {"a": sorted({0, *r.sample(range(3_600_000_000, 3_600_000_600), 400), 86_400_000_000_000}), "b": [7]}
    else:
        places = {k: sorted({int(r.expovariate(1e-6)) - 10**6 for _ in range(250)}) for k in ("a", "b", None)}
    return [(k, p, r.choice([None, r.randrange(10)])) for k, at in places.items() for p in at]


@pytest.mark.parametrize("kind", ["far apart", "one dense hour", "skewed"])
def test_slices_are_bounded_and_in_order(spark, kind):
    rows = sequences(kind)
    df = cut(spark.createDataFrame(rows, "k string, p long, v int").repartition(5))
    got = counted_slices(df, ["k"], "p", 16).collect()
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        mine = sorted((r.p, r._lo) for r in got if r.k == key)
        assert all(lo <= p for p, lo in mine) and [lo for _, lo in mine] == sorted(lo for _, lo in mine)
        sizes = [sum(lo == x for _, lo in mine) for x in {lo for _, lo in mine}]
        assert max(sizes) <= 32 and len(sizes) <= 4 + len(mine) // 4


@pytest.mark.parametrize("kind", ["far apart", "one dense hour", "skewed"])
@pytest.mark.parametrize("rows", [4, 1000])
def test_scan_matches_plain_python(spark, kind, rows):
    data = sequences(kind)
    df = cut(spark.createDataFrame(data, "k string, p long, v int").repartition(5))
    v = F.col("v")
    got = scan(
        df, ["k"], ["p"], before={"prev": v, "prev_some": (v, v.isNotNull())}, upto={"last_some": (v, v.isNotNull())},
        after={"next_big": (v, v > 5)}, sums={"running": v}, totals={"total": v}, lows={"low": v}, rows=rows,
    ).collect()
    assert len(got) == len(data)
    for key in {k for k, _, _ in data}:
        seq = sorted((p, x) for k, p, x in data if k == key)
        mine = {r.p: r for r in got if r.k == key}
        for i, (p, value) in enumerate(seq):
            r, past, later = mine[p], [x for _, x in seq[:i]], [x for _, x in seq[i + 1 :]]
            some = [x for x in past if x is not None]
            assert r.prev == (past[-1] if past else None) and r.prev_some == (some[-1] if some else None)
            assert r.last_some == (value if value is not None else r.prev_some)
            assert r.next_big == next((x for x in later if x is not None and x > 5), None)
            assert r.running == sum(x for x in [*past, value] if x is not None)
            assert (r.total or 0) == sum(x for _, x in seq if x is not None)
            assert r.low == min((x for x in later if x is not None), default=None)


def test_false_discovery_of_a_skewed_family(spark):
    from tandemtape.operators import inference

    r = random.Random(8)
    values = [1 - r.random() * 1e-9 for _ in range(600)] + [r.random() ** 40 for _ in range(200)] + [0.0, 0.0, 1.0, 1e-310, 1e-300]
    tests = spark.createDataFrame([("f", p) for p in values] + [("g", 0.5), ("f", None), ("g", float("nan"))], "fam string, raw_p_value double")
    got = inference.false_discovery(tests, family=["fam"], slice_rows=32).where("fam = 'f' AND raw_p_value IS NOT NULL").collect()
    ordered, m, low, expected = sorted(values), len(values), 1.0, {}
    for rank in range(m, 0, -1):
        low = min(low, ordered[rank - 1] * m / rank)
        expected[ordered[rank - 1]] = min(expected.get(ordered[rank - 1], 1.0), low)
    assert len(got) == m and all(x.adjusted_p_value == pytest.approx(expected[x.raw_p_value], rel=1e-12) for x in got)


def test_no_rows(spark):
    assert scan(spark.createDataFrame([], "k string, p long"), ["k"], ["p"], before={"b": F.col("p")}).collect() == []


def test_missing_spans_shuffle_the_ids_once(spark):
    ids = spark.createDataFrame([("s", i * 10**9) for i in range(50)] + [("s", 5), (None, 1), (None, 4)], "k string, id long")
    spans = investigation.missing_spans(ids, ["k"], "id")
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = sorted((r.missing_from, r.missing_to) for r in spans.where("k = 's'").collect())
    assert got[:3] == [(1, 4), (6, 10**9 - 1), (10**9 + 1, 2 * 10**9 - 1)] and len(got) == 50
    assert [(r.missing_from, r.missing_to) for r in spans.where("k is null").collect()] == [(2, 3)]


@pytest.mark.parametrize("operator", ["scan", "carry"])
def test_rows_ahead_are_not_read_anew_for_each_row(spark, monkeypatch, operator):
    """A frame from the row after the current one to the end costs the square of the rows in a slice."""
    from tandemtape.operators import ordered, scans

    monkeypatch.setattr(scans, "cut", lambda df: df)
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    ahead = {"next": (F.col("v"), F.col("v") == 0)}
    if operator == "scan":
        got = scan(df, ["k"], ["p"], after=ahead, lows={"low": F.col("v")})
    else:
        got = ordered.carry(*ordered.sliced(df, ["k"], ["p"], "p", 1000), after=ahead)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "RowFrame, 1, unboundedfollowing" not in plan
    assert got.where("p = 4990").first().next == 0 and got.where("next IS NULL").count() == 5000 - 4998
