"""Lattice rules on tiny inputs and the estimates against direct least squares."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtape.functions import tails
from tandemtape.operators import econometrics, inference, leadlag, series, sync


def quotes(spark, rows):
    """rows: (venue, ms, mid)"""
    return spark.createDataFrame(
        [("a", v, i, int(ms * 1000), float(m), float(m)) for i, (v, ms, m) in enumerate(rows)],
        "attempt_id string, venue string, record_index long, ts_us long, bid_price double, ask_price double",
    )


def bounds(spark, start_ms, end_ms):
    return spark.createDataFrame([("a", start_ms * 1000, end_ms * 1000)], "attempt_id string, start_us long, end_us long")


def test_as_of_staleness_and_null_ages(spark):
    q = quotes(spark, [("coinbase", 0, 100), ("coinbase", 100, 101), ("kraken", 150, 100), ("kraken", 150, 102), ("coinbase", 900, 103)])
    cfg = sync.SyncConfig(sampling_ms=100, stale_ms=300, tolerance_ms=50, trim_ms=0)
    got = {r.cell: r for r in sync.synchronize(q, bounds(spark, 0, 900), cfg).collect()}
    assert len(got) == 10
    assert got[1].cb_mid == 101 and got[1].kr_mid is None and got[1].rejection_reason == "none"  # no quote yet: null age passes
    assert got[2].kr_mid == 102  # of equal times the later record counts
    assert got[4].cb_age_ms == 300 and got[4].rejection_reason == "none"  # strict comparison
    assert got[5].rejection_reason == "COINBASE_STALE" and got[9].rejection_reason == "KRAKEN_STALE"
    strict = {r.cell: r for r in sync.synchronize(q, bounds(spark, 0, 900), sync.SyncConfig("strict", 100, 50, 300, 0, True)).collect()}
    assert strict[3].rejection_reason == "ALIGNMENT_TOLERANCE_EXCEEDED" and strict[2].rejection_reason == "ALIGNMENT_TOLERANCE_EXCEEDED"


def test_designs_share_one_pass_and_match_separate_runs(spark):
    rng = np.random.default_rng(1)
    rows = sorted([(v, float(t), 100 + rng.normal()) for v in ("coinbase", "kraken") for t in rng.uniform(0, 60_000, 300)], key=lambda r: r[1])
    q, b = quotes(spark, rows), bounds(spark, 0, 60_000)
    base = sync.SyncConfig(trim_ms=2000, stale_ms=400)
    pooled = {r.configuration_id: r for r in sync.robustness(q, b, sync.designs(base)).where("scope = 'per_attempt'").collect()}
    for c in sync.designs(base):
        alone = sync.spread_rows(sync.synchronize(q, b, c), ["attempt_id"]).collect()[0]
        assert pooled[c.name].candidate_count == alone.candidate_count
        assert pooled[c.name].accepted_count == alone.accepted_count
        assert pooled[c.name].spread_metric == pytest.approx(alone.mean_signed_spread, rel=1e-12)


def test_planted_lead_shows_at_its_lag(spark):
    rng = np.random.default_rng(2)
    steps = rng.normal(0, 1e-3, 400).cumsum()
    rows = []
    for i in range(400):
        rows.append(("kraken", i * 100, 100 * math.exp(steps[i])))
        if i >= 2:
            rows.append(("coinbase", i * 100, 100 * math.exp(steps[i - 2])))
    cfg = sync.SyncConfig(trim_ms=0)
    grid = sync.synchronize(quotes(spark, rows), bounds(spark, 200, 39_900), cfg)
    got = {r.lag: r for r in leadlag.lead_lag(grid, cfg, (-200, 0, 200)).collect()}
    assert got[200].correlation == pytest.approx(1.0, abs=1e-9) and got[200].direction == "kraken_leads_coinbase"
    assert abs(got[-200].correlation) < 0.3
    mirrored = {r.lag: r for r in leadlag.lead_lag(grid, cfg, (-200, 200), as_published=True).collect()}
    assert mirrored[-200].correlation == pytest.approx(1.0, abs=1e-9)  # the published sign rule repeats the positive lag


def test_gap_breaks_returns_and_segments(spark):
    # One missing stretch on a 100 ms lattice, horizon 300 ms.
    fine = spark.createDataFrame(
        [("a", c, c * 100_000, 0, 1_500_000, 100.0 + c, 100.0 + c, c not in (5, 6, 7, 8)) for c in range(16)],
        "attempt_id string, cell long, anchor_us long, start_us long, end_us long, cb_mid double, kr_mid double, accepted boolean",
    )
    spec = series.SeriesSpec("baseline", 100, 300, 100, 0)
    anchors = series.anchored_returns(fine, spec, 100)
    rows = series.labelled(anchors)
    d = series.diagnostics(anchors, rows, minimum=3).collect()[0]
    assert (d.input_synchronized_rows, d.accepted_input_rows, d.usable_return_pairs, d.gap_count) == (16, 12, 6, 1)
    assert d.maximum_gap == 500.0 and d.longest_contiguous_segment == 6 and d.longest_return_run == 4 and d.status == "COMPUTED"
    one = next(r for r in rows.collect() if r.cell == 1)
    assert one.cb_return == pytest.approx(math.log(104) - math.log(101)) and one.valid


def simulated(n=700, seed=42):
    rng = np.random.default_rng(seed)
    y = np.zeros((n, 2))
    a1, a2 = np.array([[0.2, 0.25], [0.0, 0.3]]), np.array([[0.1, 0.0], [0.05, -0.2]])
    for t in range(2, n):
        y[t] = 0.01 + a1 @ y[t - 1] + a2 @ y[t - 2] + rng.normal(0, [1.0, 0.7])
    return y * 1e-5


@pytest.fixture(scope="module")
def fitted(spark):
    y = simulated()
    df = spark.createDataFrame(
        [("a", "baseline", i, len(y), float(p), float(q)) for i, (p, q) in enumerate(y)],
        "attempt_id string, configuration_id string, pos long, n long, y1 double, y2 double",
    )
    return y, df, econometrics.return_models(df).collect()[0], econometrics.return_models(df)


def design(y, p, t0):
    n = len(y)
    return np.column_stack([np.ones(n - t0)] + [y[t0 - k : n - k, i] for k in range(1, p + 1) for i in (0, 1)]), y[t0:]


def test_autoregression_against_direct_least_squares(fitted):
    y, _, row, _ = fitted
    n = len(y)
    best = []
    for p in range(11):
        x, target = design(y, p, 10)
        e = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
        m = len(target)
        best.append(math.log(np.linalg.det(e.T @ e / m)) + math.log(m) / m * (4 * p + 2))
    p = max(int(np.argmin(best)), 1)
    assert row.lag == p
    x, target = design(y, p, p)
    b = np.linalg.lstsq(x, target, rcond=None)[0]
    assert np.allclose(np.array(row.coefficients).reshape(b.shape), b, rtol=1e-7, atol=1e-12)
    e = target - x @ b
    sigma = e.T @ e / (n - p - 2 * p - 1)
    inv = np.linalg.inv(x.T @ x)
    assert np.allclose(np.array(row.standard_errors), np.sqrt(np.outer(np.diag(inv), np.diag(sigma))).ravel(), rtol=1e-7)
    g = {r.direction: r for r in row.granger}["kraken_predicts_coinbase"]
    at = [2 + 2 * k for k in range(p)]
    wald = b[at, 0] @ np.linalg.solve(inv[np.ix_(at, at)] * sigma[0, 0], b[at, 0]) / p
    assert g.statistic == pytest.approx(wald, rel=1e-7) and (g.df1, g.df2) == (p, 2 * (n - p - 2 * p - 1))
    root = np.linalg.cholesky(sigma)
    first = {(r.ordering, r.horizon): r.response for r in row.irf}
    assert first["coinbase_first", 0] == pytest.approx(root[1, 0], rel=1e-7) and first["kraken_first", 0] == pytest.approx(0.0, abs=1e-12)
    assert first["coinbase_first", 1] == pytest.approx((b[1:3].T @ root)[1, 0], rel=1e-7)
    assert row.stable and len(row.irf) == 42


def test_unit_root_against_direct_least_squares(fitted):
    y, _, row, _ = fitted
    x = y[:, 0]
    d = np.diff(x)

    def fit(k, t0):
        cols = [np.ones(len(x) - t0), x[t0 - 1 : -1]] + [d[t0 - 1 - j : len(d) - j] for j in range(1, k + 1)]
        z, target = np.column_stack(cols), d[t0 - 1 :]
        b = np.linalg.lstsq(z, target, rcond=None)[0]
        ssr, n = float(((target - z @ b) ** 2).sum()), len(target)
        return n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * z.shape[1], b[1] / math.sqrt(ssr / (n - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])

    k = min(range(13), key=lambda j: fit(j, 13)[0])
    got = {r.venue: r for r in row.adf}["coinbase"]
    assert got.lags == k and got.statistic == pytest.approx(fit(k, k + 1)[1], rel=1e-6) and got.observations == len(x) - 1 - k
    assert econometrics.adf_p_value(-2.86) == pytest.approx(0.0502, abs=2e-4)
    assert got.critical[1] == pytest.approx(-2.866, abs=5e-3)


def test_predictive_regression_against_direct_sandwich(spark, fitted):
    y, df, _, models = fitted
    got = {r.direction: r for r in econometrics.predictive_regressions(df, models).collect()}["kraken_predicts_coinbase"]
    x, t = np.column_stack([np.ones(len(y) - 1), y[:-1, 1], y[:-1, 0]]), y[1:, 0]
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    g = x * (t - x @ b)[:, None]
    cross = g[1:].T @ g[:-1]
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ (g.T @ g + 0.5 * (cross + cross.T)) @ inv
    assert got.coefficient == pytest.approx(b[1], rel=1e-8)
    assert got.standard_error == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-8)
    assert got.raw_p_value == pytest.approx(math.erfc(abs(got.t_statistic) / math.sqrt(2)), rel=1e-12)


def test_constant_series_is_invalid(spark):
    df = spark.createDataFrame([("a", "baseline", i, 400, 0.0, float(v)) for i, v in enumerate(np.random.default_rng(4).normal(size=400))], "attempt_id string, configuration_id string, pos long, n long, y1 double, y2 double")
    models = econometrics.return_models(df)
    row = models.collect()[0]
    assert row.fit_status == "MODEL_INVALID" and row.lag is None
    assert {r.venue: r.status for r in econometrics.stationarity(models).collect()} == {"coinbase": "MODEL_INVALID", "kraken": "COMPUTED"}


def test_cointegrated_pair_is_rank_one_and_shares_are_sound(spark):
    rng = np.random.default_rng(8)
    n = 1500
    walk = rng.normal(0, 1, n).cumsum()
    y = np.column_stack([walk + rng.normal(0, 1, n), walk + rng.normal(0, 2, n)]) * 1e-4
    y -= y[0]
    df = spark.createDataFrame([("a", "baseline", i, n, float(p), float(q)) for i, (p, q) in enumerate(y)], "attempt_id string, configuration_id string, pos long, n long, y1 double, y2 double")
    coint = econometrics.cointegration(econometrics.level_models(df))
    row = coint.collect()[0]
    assert row.inferred_cointegration_rank == 1 and row.cointegrating_vector[1] == pytest.approx(-1, abs=0.1)
    d = np.diff(y, axis=0)
    z = np.column_stack([np.ones(n - 2), d[:-1]])
    res = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0]
    r0, r1 = res(d[1:]), res(y[1:-1])
    s00, s01, s11 = r0.T @ r0, r0.T @ r1, r1.T @ r1
    values = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real)[::-1]
    assert row.johansen_trace_statistics[0] == pytest.approx(-(n - 2) * np.log(1 - values).sum(), rel=1e-7)
    shares = {r.metric: r for r in econometrics.price_discovery(coint).collect()}
    gg, hb = shares["GONZALO_GRANGER_COMPONENT_SHARE"], shares["HASBROUCK_INFORMATION_SHARE"]
    assert gg.coinbase_value + gg.kraken_value == pytest.approx(1)
    assert 0 <= hb.coinbase_lower <= hb.coinbase_upper <= 1 and hb.coinbase_lower + hb.kraken_upper == pytest.approx(1)


def test_share_edge_cases(spark):
    one = spark.range(1)
    a = [F.lit(v) for v in (-0.20, 0.10)]
    gg = one.select(*[c.alias(n) for c, n in zip(econometrics.component_shares(*a), "pq")]).collect()[0]
    assert gg.p == pytest.approx(1 / 3)
    bounds_ = econometrics.information_bounds(*a, F.lit(1.0), F.lit(2.0), F.lit(1.0))
    assert one.select(bounds_[0].alias("x")).collect()[0].x is None  # covariance not positive definite
    # Published pairs of adjustment coefficients and weights.
    for a1, a2, p in ((-0.0011326276264355785, 0.03461721038994975, 0.9683179647998276), (0.003585636068134843, 0.015868422270113154, 1.29192367343798)):
        got = one.select(econometrics.component_shares(F.lit(a1), F.lit(a2))[0].alias("x")).collect()[0].x
        assert got == pytest.approx(p, rel=1e-12)


def test_tails_against_published_values():
    assert tails.f_tail_value(48.69318684081113, 2, 794) == pytest.approx(1.1286026880120984e-20, rel=1e-9)
    assert tails.normal_two_sided_value(1.4164852524194351) == pytest.approx(0.15663347901092722, rel=1e-12)


def test_fisher_and_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("z", 0.0), ("z", 0.5), ("n", None)], "k string, raw_p_value double")
    got = {r.k: r for r in inference.fisher(df, ["k"]).collect()}
    assert got["a"].fisher_statistic == pytest.approx(15.648092021712582) and got["a"].degrees_of_freedom == 4
    assert got["a"].combined_p_value == pytest.approx(0.0035296184043425217, rel=1e-12)
    assert got["z"].fisher_statistic == math.inf and got["z"].combined_p_value == 0.0
    assert got["n"].fisher_statistic is None and got["n"].contributing_attempt_count == 0
    p = [0.01, 0.02, 0.03, 0.04, 0.05, 0.5, 1e-300, 0.04]
    out = inference.false_discovery(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, raw_p_value double")).collect()
    order = np.argsort(p, kind="stable")
    raw = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    expected = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert {r.i: r.adjusted_p_value for r in out} == pytest.approx({int(k): v for k, v in zip(order, expected)})


def test_equal_weight_ignores_sample_sizes(spark):
    df = spark.createDataFrame([("c", "m", "COMPUTED", 0.0), ("c", "m", "COMPUTED", 1.0), ("c", "m", "COMPUTED", float("nan")), ("d", "m", "NOT_ESTIMABLE", None)], "configuration_id string, metric string, status string, value double")
    got = {r.configuration_id: r for r in inference.equal_weight_mean(df).collect()}
    assert (got["c"].value, got["c"].contributing_attempt_count, got["d"].status) == (0.5, 2, "NOT_ESTIMABLE")
