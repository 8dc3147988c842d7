"""Queries over return and level series: runs, gates, estimates, inference and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.operators import econometrics, inference, moments, series, sync
from tandemtape.plans.prices import CONFIG, UNIT, grid_sql
from tandemtape.plans.registry import block, query, rounded, stage, using
from tandemtape.session import cut
from tandemtape.sources import samples

SPECS = series.specifications(CONFIG, UNIT)
BASELINE = SPECS[0]
STEP_MS = 300_000


def fine(spark, folder) -> DataFrame:
    """The finest lattice all configurations draw from."""

    def build():
        quotes = samples.trend(spark, folder)
        rows, step = series.support(quotes, sync.overlap(quotes), CONFIG, SPECS)
        assert step == STEP_MS
        return rows

    return stage(spark, folder, "lattice", build)


def labelled(spark, folder, spec=BASELINE, grid: DataFrame | None = None):
    grid = fine(spark, folder) if grid is None else grid
    anchors = series.anchored_returns(grid, spec, STEP_MS)
    if spec is BASELINE:
        return anchors, stage(spark, folder, "baseline_series", lambda: series.labelled(anchors))
    return anchors, series.labelled(anchors)


# --- SQL blocks ------------------------------------------------------------------------------------------------------
block("summed", """
  SELECT *, sum(cents) OVER (PARTITION BY attempt_id ORDER BY record_index) AS running, row_number() OVER (PARTITION BY attempt_id ORDER BY record_index) AS nth,
    sum(cents) OVER (PARTITION BY attempt_id) AS whole, count(*) OVER (PARTITION BY attempt_id) AS n FROM base""")
block("trend", samples.trend_sql())
block("t1", "SELECT attempt_id, ts_us, arg_max((price + price) / 2.0, record_index) AS mid FROM trend WHERE venue = 'coinbase' GROUP BY 1, 2")
block("t2", "SELECT attempt_id, ts_us, arg_max((price + price) / 2.0, record_index) AS mid FROM trend WHERE venue = 'kraken' GROUP BY 1, 2")
block("tfine", f"""
  SELECT *, CASE WHEN cb_age_ms > {CONFIG.stale_ms} OR kr_age_ms > {CONFIG.stale_ms} THEN false ELSE true END AS accepted,
    coalesce(cb_mid > 0 AND kr_mid > 0, false) AND NOT coalesce(cb_age_ms > {CONFIG.stale_ms} OR kr_age_ms > {CONFIG.stale_ms}, false) AS ok
  FROM ({grid_sql(300_000_000, 0, "t1", "t2")})""")
FINE = "base ticks bounds summed trend t1 t2 tfine"


def anchors_sql(spec: series.SeriesSpec) -> str:
    trim, every = spec.trim_ms // STEP_MS, spec.endpoint_ms // STEP_MS
    h, keep = spec.horizon_ms // spec.endpoint_ms, spec.sampling_ms // STEP_MS
    return f"""
  SELECT attempt_id, cell, anchor_us, accepted, cb_mid, kr_mid, valid, CASE WHEN valid THEN cb_end - ln(cb_mid) END AS y1, CASE WHEN valid THEN kr_end - ln(kr_mid) END AS y2
  FROM (SELECT *, sum(ok::INT) OVER (w ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = {h + 1} AS valid, lead(ln(cb_mid), {h}) OVER w AS cb_end, lead(ln(kr_mid), {h}) OVER w AS kr_end
        FROM tfine WHERE cell >= {trim} AND (cell - {trim}) % {every} = 0 AND anchor_us <= end_us - {spec.trim_ms * 1000} WINDOW w AS (PARTITION BY attempt_id ORDER BY cell))
  WHERE (cell - {trim}) % {keep} = 0"""


def rows_sql(spec: series.SeriesSpec, anchors: str) -> str:
    return f"""
  SELECT *, sum((NOT valid)::INT) OVER w AS run, sum(is_gap::INT) OVER w AS segment, row_number() OVER w AS seq FROM (
    SELECT *, step_ms > {3 * spec.sampling_ms} AND step_ms IS NOT NULL AS is_gap FROM (
      SELECT *, (anchor_us - lag(anchor_us) OVER (PARTITION BY attempt_id ORDER BY cell)) / 1000.0 AS step_ms FROM {anchors} WHERE accepted))
  WINDOW w AS (PARTITION BY attempt_id ORDER BY cell)"""


block("anchors", anchors_sql(BASELINE))
block("rws", rows_sql(BASELINE, "anchors"))
block("runs", """
  SELECT attempt_id, run, n, first FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY n DESC, first) AS place FROM
    (SELECT attempt_id, run, count(*) AS n, min(seq) AS first FROM rws WHERE valid GROUP BY 1, 2)) WHERE place = 1""")
block("segs", """
  SELECT attempt_id, segment, n, first FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY n DESC, first) AS place FROM
    (SELECT attempt_id, segment, count(*) AS n, min(seq) AS first FROM rws GROUP BY 1, 2)) WHERE place = 1""")
SERIES = FINE + " anchors rws runs segs"


@query("trend_quotes", using("base summed trend", "SELECT record_index, attempt_id, venue, round(price, 8) AS price FROM trend"))
def trend_quotes(spark, folder):
    return rounded(samples.trend(spark, folder).select("record_index", "attempt_id", "venue", "price"), 8)


@query("exact_lattice", using(FINE, """
  SELECT attempt_id, count(*) AS points, min(anchor_us) AS first_us, max(anchor_us) AS last_us FROM
    (SELECT *, min(anchor_us) OVER (PARTITION BY attempt_id) AS t0 FROM tfine) WHERE (anchor_us - t0) % 1500000000 = 0 GROUP BY 1"""))
def exact_lattice(spark, folder):
    return series.thinned(fine(spark, folder), 250 * UNIT).groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("points"), F.min("anchor_us").alias("first_us"), F.max("anchor_us").alias("last_us")
    )


@query("forward_returns", using(FINE + " anchors", """
  SELECT attempt_id, cell, accepted, valid, round(y1, 9) + 0.0 AS cb_return, round(y2, 9) + 0.0 AS kr_return FROM anchors"""))
def forward_returns(spark, folder):
    rows = series.anchored_returns(fine(spark, folder), BASELINE, STEP_MS)
    return rounded(rows.select("attempt_id", "cell", "accepted", "valid", "cb_return", "kr_return"), 9)


_ALL_ANCHORS = " UNION ALL ".join(f"SELECT '{s.name}' AS configuration_id, * FROM ({anchors_sql(s)})" for s in SPECS)


@query("configured_returns", using(FINE, f"""
  SELECT configuration_id, attempt_id, count(*) FILTER (accepted) AS anchors, count(*) FILTER (accepted AND valid) AS returns,
    round(sum(y1) FILTER (accepted), 7) + 0.0 AS cb_sum, round(sum(y2) FILTER (accepted), 7) + 0.0 AS kr_sum FROM ({_ALL_ANCHORS}) GROUP BY 1, 2"""))
def configured_returns(spark, folder):
    grid = fine(spark, folder)
    rows = series.configured(grid, SPECS, STEP_MS).where("accepted")
    return rounded(
        rows.groupBy("configuration_id", "attempt_id").agg(
            F.count(F.lit(1)).alias("anchors"), F.count_if("valid").alias("returns"), F.sum("cb_return").alias("cb_sum"), F.sum("kr_return").alias("kr_sum")
        ), 7)


@query("series_diagnostics", using(SERIES, """
  SELECT attempt_id, 'baseline' AS configuration_id, CAST(600000 AS BIGINT) AS sampling_interval_ms, CAST(600000 AS BIGINT) AS return_horizon_ms, input_synchronized_rows,
    accepted_input_rows, usable_return_pairs, gap_count, maximum_gap, s.n - 1 AS longest_contiguous_segment, r.n AS longest_return_run, series_start_us, series_end_us,
    round((series_end_us - series_start_us) / 1e6, 6) AS effective_duration, round(gap_count / (accepted_input_rows - 1), 6) AS missing_share,
    CASE WHEN r.n >= 300 THEN 'COMPUTED' ELSE 'INSUFFICIENT_SAMPLE' END AS status,
    CASE WHEN r.n >= 300 THEN NULL ELSE 'Longest contiguous return segment below min obs' END AS insufficiency_reason
  FROM (SELECT attempt_id, count(*) AS input_synchronized_rows FROM anchors GROUP BY 1)
  JOIN (SELECT attempt_id, count(*) AS accepted_input_rows, count(*) FILTER (valid) AS usable_return_pairs, count(*) FILTER (is_gap) AS gap_count, max(step_ms) AS maximum_gap,
        min(anchor_us) AS series_start_us, max(anchor_us) AS series_end_us FROM rws GROUP BY 1) USING (attempt_id)
  JOIN runs r USING (attempt_id) JOIN segs s USING (attempt_id)"""))
def series_diagnostics(spark, folder):
    anchors, rows = labelled(spark, folder)
    return rounded(series.diagnostics(anchors, rows))


@query("longest_runs", using(SERIES, """
  SELECT 'return' AS kind, attempt_id, n AS run_length, first AS run_start, first + n - 1 AS run_end FROM runs
  UNION ALL SELECT 'level', attempt_id, n, first, first + n - 1 FROM segs"""))
def longest_runs(spark, folder):
    _, rows = labelled(spark, folder)
    columns = ("attempt_id", "run_length", "run_start", "run_end")
    return series.runs(rows).select(F.lit("return").alias("kind"), *columns).unionAll(
        series.segments(rows).select(F.lit("level"), *columns)
    )


# Two-step-apart longest runs over conversations exercise runs on a second table.
@query("conversation_runs", """
  SELECT conv_id, run_length, run_start, run_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY run_length DESC, run_start) AS place FROM (
    SELECT conv_id, run, count(*) AS run_length, min(turn) AS run_start, max(turn) AS run_end FROM (
      SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
        SELECT conv_id, turn, CASE WHEN lag(length(text) > 60) OVER (PARTITION BY conv_id ORDER BY turn) = (length(text) > 60) THEN 0 ELSE 1 END AS new FROM conversations)) GROUP BY 1, 2)) WHERE place = 1""")
def conversation_runs(spark, folder):
    from tandemtape.operators.ordered import carry, longest_run, sliced

    rows = samples.table(spark, folder, "conversations").select("conv_id", "turn", (F.length("text") > 60).alias("long"))
    cut_rows, track = sliced(rows, ["conv_id"], ["turn"], "turn")
    flagged = carry(cut_rows, track, before={"_p": F.col("long")}).withColumn("_new", F.when(F.col("_p") == F.col("long"), 0).otherwise(1))
    runs = carry(flagged, track, sums={"run": F.col("_new")})
    return longest_run(runs, ["conv_id"], "run", "turn").select("conv_id", "run_length", "run_start", "run_end")


# --- estimates -------------------------------------------------------------------------------------------------------
def returns(spark, folder, grid=None) -> DataFrame:
    _, rows = labelled(spark, folder, BASELINE, grid)
    return series.model_returns(rows)


def baseline_models(spark, folder) -> DataFrame:
    return stage(spark, folder, "return_models", lambda: econometrics.return_models(returns(spark, folder)))


def estimates(spark, folder) -> dict[str, DataFrame]:
    """Everything of the baseline; the two tables several estimates read are materialised once."""
    grid = fine(spark, folder)
    _, rows = labelled(spark, folder, BASELINE, grid)
    ret = series.model_returns(rows)
    models = baseline_models(spark, folder)
    coint = cut(econometrics.cointegration(econometrics.level_models(series.model_levels(rows))))
    return {"returns": ret, "models": models, "coint": coint, "grid": grid}


# Cross-products of the longest run at lags 0, 1 and 13.
_LAGS = (0, 1, 13)
block("model", """
  SELECT attempt_id, seq - first AS pos, n, y1, y2 FROM rws JOIN runs USING (attempt_id, run) WHERE valid AND n >= 300""")


@query("lagged_cross_products", using(SERIES + " model", f"""
  SELECT attempt_id, n, round(s1, 7) + 0.0 AS sum_1, round(s2, 7) + 0.0 AS sum_2, {', '.join(f'round(c{i}{j}_{d} * 1e4, 6) + 0.0 AS c_{i}{j}_{d}' for i, j in moments.PAIRS for d in _LAGS)}
  FROM (SELECT attempt_id, max(n) AS n, sum(y1) AS s1, sum(y2) AS s2, {', '.join(f'sum(y{i} * l{j}_{d}) AS c{i}{j}_{d}' for i, j in moments.PAIRS for d in _LAGS)}
    FROM (SELECT *, {', '.join(f'lag(y{j}, {d}) OVER w AS l{j}_{d}' for j in (1, 2) for d in _LAGS)} FROM model WINDOW w AS (PARTITION BY attempt_id ORDER BY pos)) GROUP BY 1)"""))
def lagged_cross_products(spark, folder):
    out = moments.lag_products(returns(spark, folder), econometrics.KEYS)
    depth = moments.DEPTH + 1
    return out.select(
        "attempt_id", "n", *[(F.round(F.col("sums")[k], 7) + 0.0).alias(f"sum_{k + 1}") for k in (0, 1)],
        *[(F.round(F.col("products")[k * depth + d] * 1e4, 6) + 0.0).alias(f"c_{i}{j}_{d}") for k, (i, j) in enumerate(moments.PAIRS) for d in _LAGS],
    )


@query("unit_root_tests")
def unit_root_tests(spark, folder):
    return econometrics.stationarity(baseline_models(spark, folder))


@query("vector_autoregression")
def vector_autoregression(spark, folder):
    return econometrics.var_table(baseline_models(spark, folder))


@query("granger_causality")
def granger_causality(spark, folder):
    return inference.false_discovery(econometrics.granger(baseline_models(spark, folder)))


@query("impulse_responses")
def impulse_responses(spark, folder):
    return econometrics.impulse_responses(baseline_models(spark, folder))


def _regression_sql(name: str, p: str, o: str) -> str:
    """Partial the constant and own lag out of the predictor; the sandwich then needs one regressor only."""
    return f"""
  SELECT attempt_id, '{name}' AS direction, round(b, 6) + 0.0 AS coefficient, round(sqrt(s0 + s1) / rr, 6) AS standard_error, round(b / (sqrt(s0 + s1) / rr), 5) + 0.0 AS t_statistic, m AS effective_sample_count
  FROM (SELECT attempt_id, any_value(b) AS b, any_value(rr) AS rr, count(*) AS m, sum(g * g) AS s0, sum(g * g1) AS s1 FROM (
    SELECT *, lag(g) OVER (PARTITION BY attempt_id ORDER BY pos) AS g1 FROM (
      SELECT attempt_id, pos, b, rr, (p - slope * o) * (y - b * p - c * o) AS g FROM (
        SELECT attempt_id, pos, p - mp AS p, o - mo AS o, y - my AS y, spo / soo AS slope, spp - spo * spo / soo AS rr,
          (spy * soo - soy * spo) / (spp * soo - spo * spo) AS b, (soy * spp - spy * spo) / (spp * soo - spo * spo) AS c
        FROM pairs_{name} JOIN (SELECT attempt_id, avg(p) AS mp, avg(o) AS mo, avg(y) AS my, var_pop(p) * count(*) AS spp, var_pop(o) * count(*) AS soo, covar_pop(p, o) * count(*) AS spo,
             covar_pop(p, y) * count(*) AS spy, covar_pop(o, y) * count(*) AS soy FROM pairs_{name} GROUP BY 1) USING (attempt_id)))) GROUP BY 1)"""


for _name, _p, _o in (("kraken_predicts_coinbase", "y2", "y1"), ("coinbase_predicts_kraken", "y1", "y2")):
    block(f"pairs_{_name}", f"""
  SELECT * FROM (SELECT attempt_id, pos, lag({_p}) OVER w AS p, lag({_o}) OVER w AS o, {_o} AS y FROM model WINDOW w AS (PARTITION BY attempt_id ORDER BY pos)) WHERE pos >= 1""")


@query("predictive_regressions", using(
    SERIES + " model pairs_kraken_predicts_coinbase pairs_coinbase_predicts_kraken",
    _regression_sql("kraken_predicts_coinbase", "y2", "y1") + " UNION ALL " + _regression_sql("coinbase_predicts_kraken", "y1", "y2")))
def predictive_regressions(spark, folder):
    out = econometrics.predictive_regressions(returns(spark, folder), baseline_models(spark, folder))
    return out.select(
        "attempt_id", "direction", (F.round("coefficient", 6) + 0.0).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"),
        (F.round("t_statistic", 5) + 0.0).alias("t_statistic"), "effective_sample_count",
    )


# Closed form of the two-series cointegration problem.
block("levels", """
  SELECT attempt_id, ln(cb_mid) - ln(cb0) AS l1, ln(kr_mid) - ln(kr0) AS l2, seq - first AS pos, n FROM rws JOIN segs USING (attempt_id, segment)
    JOIN (SELECT attempt_id, seq AS first, cb_mid AS cb0, kr_mid AS kr0 FROM rws) USING (attempt_id, first)
  WHERE attempt_id IN (SELECT attempt_id FROM runs WHERE n >= 300)""")
_V = ("d1", "d2", "z1", "z2", "k1", "k2")
block("lagged_levels", """
  SELECT attempt_id, n, l1 - a1 AS d1, l2 - a2 AS d2, a1 - b1 AS z1, a2 - b2 AS z2, a1 AS k1, a2 AS k2 FROM (
    SELECT *, lag(l1) OVER w AS a1, lag(l2) OVER w AS a2, lag(l1, 2) OVER w AS b1, lag(l2, 2) OVER w AS b2 FROM levels WINDOW w AS (PARTITION BY attempt_id ORDER BY pos)) WHERE pos >= 2""")
block("level_cov", f"""
  SELECT attempt_id, max(n) AS n, count(*) AS t, {', '.join(f'covar_pop({a}, {b}) AS {a}{b}' for a in _V for b in _V)} FROM lagged_levels GROUP BY 1""")


def _part(a: str, b: str) -> str:
    return (f"({a}{b} - ({a}z1 * (z2z2 * z1{b} - z1z2 * z2{b}) + {a}z2 * (z1z1 * z2{b} - z1z2 * z1{b})) / (z1z1 * z2z2 - z1z2 * z1z2))")


block("parted", f"""
  SELECT attempt_id, n, t, {', '.join(f'{_part(a, b)} AS {a}{b}' for a in ('d1', 'd2', 'k1', 'k2') for b in ('d1', 'd2', 'k1', 'k2'))} FROM level_cov""")
block("pencil", """
  SELECT *, (k2k2 * q11 - k1k2 * q21) / dk AS m11, (k2k2 * q12 - k1k2 * q22) / dk AS m12, (k1k1 * q21 - k1k2 * q11) / dk AS m21, (k1k1 * q22 - k1k2 * q12) / dk AS m22 FROM (
    SELECT *, k1k1 * k2k2 - k1k2 * k1k2 AS dk, k1d1 * w11 + k1d2 * w21 AS q11, k1d1 * w12 + k1d2 * w22 AS q12, k2d1 * w11 + k2d2 * w21 AS q21, k2d1 * w12 + k2d2 * w22 AS q22 FROM (
      SELECT *, (d2d2 * d1k1 - d1d2 * d2k1) / dd AS w11, (d2d2 * d1k2 - d1d2 * d2k2) / dd AS w12, (d1d1 * d2k1 - d1d2 * d1k1) / dd AS w21, (d1d1 * d2k2 - d1d2 * d1k2) / dd AS w22 FROM (
        SELECT *, d1d1 * d2d2 - d1d2 * d1d2 AS dd FROM parted)))""")
block("johansen", """
  SELECT *, CASE WHEN trace_0 <= 15.4943 THEN 0 WHEN trace_1 <= 3.8415 THEN 1 ELSE 2 END AS rank, (e1 - m11) / m12 AS b2 FROM (
    SELECT *, -t * (ln(1 - e1) + ln(1 - e2)) AS trace_0, -t * ln(1 - e2) AS trace_1 FROM (
      SELECT *, (m11 + m22) / 2 + sqrt((m11 - m22) * (m11 - m22) / 4 + m12 * m21) AS e1, (m11 + m22) / 2 - sqrt((m11 - m22) * (m11 - m22) / 4 + m12 * m21) AS e2 FROM pencil))""")
block("vecm", """
  SELECT *, d1d1 - a1 * a1 * bb AS v11, d1d2 - a1 * a2 * bb AS v12, d2d2 - a2 * a2 * bb AS v22 FROM (
    SELECT *, (d1k1 + b2 * d1k2) / bb AS a1, (d2k1 + b2 * d2k2) / bb AS a2 FROM (SELECT *, k1k1 + 2 * b2 * k1k2 + b2 * b2 * k2k2 AS bb FROM johansen WHERE rank = 1))""")
COINT = SERIES + " levels lagged_levels level_cov parted pencil johansen vecm"


@query("cointegration_tests", using(COINT, """
  SELECT attempt_id, n AS observations, round(trace_0, 4) AS trace_0, round(trace_1, 4) AS trace_1, j.rank AS inferred_cointegration_rank,
    CASE WHEN j.rank = 1 THEN 'ESTIMABLE' ELSE 'NOT_ESTIMABLE' END AS vecm_status, CASE WHEN j.rank <> 1 THEN 'COINTEGRATION_RANK_NOT_ONE' END AS insufficiency_reason,
    round(v.a1, 5) + 0.0 AS alpha_1, round(v.a2, 5) + 0.0 AS alpha_2, round(v.b2, 4) + 0.0 AS beta_2
  FROM johansen j LEFT JOIN (SELECT attempt_id, a1, a2, b2 FROM vecm) v USING (attempt_id)"""))
def cointegration_tests(spark, folder):
    _, rows = labelled(spark, folder)
    out = econometrics.cointegration(econometrics.level_models(series.model_levels(rows)))
    t, a, b = F.col("johansen_trace_statistics"), F.col("adjustment_coefficients"), F.col("cointegrating_vector")
    return out.select(
        "attempt_id", "observations", F.round(t[0], 4).alias("trace_0"), F.round(t[1], 4).alias("trace_1"), "inferred_cointegration_rank",
        "vecm_status", "insufficiency_reason", (F.round(a[0], 5) + 0.0).alias("alpha_1"), (F.round(a[1], 5) + 0.0).alias("alpha_2"), (F.round(b[1], 4) + 0.0).alias("beta_2"),
    )


@query("price_discovery_shares", using(COINT, """
  SELECT attempt_id, metric, 1 AS cointegration_rank, n AS effective_sample_count, 'COMPUTED' AS status, CAST(NULL AS VARCHAR) AS insufficiency_reason,
    CASE WHEN metric LIKE 'G%' THEN round(-a2 / (a1 - a2), 4) END AS coinbase_value,
    round(CASE WHEN metric LIKE 'G%' THEN -a2 / (a1 - a2) ELSE least(f1, g1) END, 4) AS coinbase_lower, round(CASE WHEN metric LIKE 'G%' THEN -a2 / (a1 - a2) ELSE greatest(f1, g1) END, 4) AS coinbase_upper,
    round(CASE WHEN metric LIKE 'G%' THEN a1 / (a1 - a2) ELSE least(1 - f1, 1 - g1) END, 4) AS kraken_lower, round(CASE WHEN metric LIKE 'G%' THEN a1 / (a1 - a2) ELSE greatest(1 - f1, 1 - g1) END, 4) AS kraken_upper
  FROM (SELECT *, pow(w1 * c11 + w2 * c21, 2) / tot AS f1, 1 - pow(w2 * sqrt(v22) + w1 * v12 / sqrt(v22), 2) / tot AS g1 FROM (
      SELECT *, -a2 AS w1, a1 AS w2, sqrt(v11) AS c11, v12 / sqrt(v11) AS c21, a2 * a2 * v11 - 2 * a1 * a2 * v12 + a1 * a1 * v22 AS tot FROM vecm))
    CROSS JOIN (VALUES ('GONZALO_GRANGER_COMPONENT_SHARE'), ('HASBROUCK_INFORMATION_SHARE')) m(metric)
  UNION ALL SELECT attempt_id, metric, rank, n, 'NOT_ESTIMABLE', 'COINTEGRATION_RANK_NOT_ONE', NULL, NULL, NULL, NULL, NULL FROM johansen
    CROSS JOIN (VALUES ('GONZALO_GRANGER_COMPONENT_SHARE'), ('HASBROUCK_INFORMATION_SHARE')) m(metric) WHERE rank <> 1"""))
def price_discovery_shares(spark, folder):
    _, rows = labelled(spark, folder)
    coint = cut(econometrics.cointegration(econometrics.level_models(series.model_levels(rows))))
    return rounded(econometrics.price_discovery(coint).drop("kraken_value"), 4)


def robustness_rows(spark, folder) -> DataFrame:
    return stage(spark, folder, "stability", lambda: _robustness(spark, folder))


def _robustness(spark, folder) -> DataFrame:
    grid = fine(spark, folder)
    anchors = cut(series.configured(grid, SPECS, STEP_MS))
    rows = series.labelled(anchors)
    models = econometrics.return_models(series.model_returns(rows))
    return econometrics.stability(series.diagnostics(anchors, rows), models, SPECS)


@query("stability_by_configuration")
def stability_by_configuration(spark, folder):
    rows = robustness_rows(spark, folder)
    return rows.select("configuration_id", "scope", "attempt_id", "effective_sample_count", "metric", "value", "status", "insufficiency_reason")


@query("stability_aggregate")
def stability_aggregate(spark, folder):
    return inference.equal_weight_mean(robustness_rows(spark, folder))


@query("aggregate_inference")
def aggregate_inference(spark, folder):
    e = estimates(spark, folder)
    return inference.aggregate_inference(econometrics.granger(e["models"]), econometrics.predictive_regressions(e["returns"], e["models"]))


def _report_parts(spark, folder) -> dict[str, DataFrame]:
    e = estimates(spark, folder)
    return e | {
        "adf": econometrics.stationarity(e["models"]), "var": econometrics.var_table(e["models"]),
        "granger": inference.false_discovery(econometrics.granger(e["models"])), "irf": econometrics.impulse_responses(e["models"]),
        "discovery": econometrics.price_discovery(e["coint"]), "regressions": econometrics.predictive_regressions(e["returns"], e["models"]),
    }


@query("estimator_support")
def estimator_support(spark, folder):
    p = _report_parts(spark, folder)
    return inference.support_counts(p["adf"], p["var"], p["granger"], p["irf"], p["coint"], p["discovery"])


@query("attempt_summary")
def attempt_summary(spark, folder):
    p = _report_parts(spark, folder)
    return inference.attempt_summary(p["coint"], p["var"], p["granger"], p["discovery"], p["regressions"])


@query("figure_tables")
def figure_tables(spark, folder):
    p = _report_parts(spark, folder)
    summary = cut(inference.attempt_summary(p["coint"], p["var"], p["granger"], p["discovery"], p["regressions"]))
    tables = inference.figure_tables(summary, p["irf"], robustness_rows(spark, folder))
    faults = inference.summary_faults(summary)
    out = faults.select(F.lit("fault").alias("figure"), "attempt_id", F.concat_ws(",", "faults").alias("item"), F.lit(None).cast("double").alias("value"))
    t = tables
    return (
        out.unionAll(t["causality_strength"].select(F.lit("causality_strength"), "attempt_id", "direction", "minus_log10_adjusted_p"))
        .unionAll(t["cumulative_response"].select(F.lit("cumulative_response"), "attempt_id", F.concat_ws(":", "ordering", F.col("horizon").cast("string")), "cumulative_response"))
        .unionAll(t["venue_shares"].select(F.lit("venue_shares"), "attempt_id", F.lit("gg_coinbase_share"), "gg_coinbase_share"))
        .unionAll(t["stability_by_configuration"].select(F.lit("stability"), "attempt_id", "configuration_id", "value"))
    )


# --- inference on whole tables ---------------------------------------------------------------------------------------
_P = "CAST((o_orderkey * 7919) % 9973 + 1 AS DOUBLE) / CAST(9974 AS DOUBLE)"
_P2 = f"(CASE WHEN o_orderkey % 5 = 0 THEN {_P} / CAST(1000 AS DOUBLE) ELSE {_P} END)"


@query("false_discovery_families", f"""
  SELECT o_orderkey, o_orderpriority, round(least(1.0, min(p * m / r) OVER (PARTITION BY o_orderpriority ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS adjusted_p_value
  FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS m, count(*) OVER (PARTITION BY o_orderpriority ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
        FROM (SELECT o_orderkey, o_orderpriority, {_P2} AS p FROM orders))""")
def false_discovery_families(spark, folder):
    rows = samples.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.expr(_P2).cast("double").alias("raw_p_value"))
    out = inference.false_discovery(rows, family=["o_orderpriority"])
    return rounded(out.select("o_orderkey", "o_orderpriority", "adjusted_p_value"), 9)


@query("fisher_by_customer", f"""
  SELECT o_custkey, k AS contributing_attempt_count, round(stat, 6) AS fisher_statistic, 2 * k AS degrees_of_freedom,
    round(list_sum(list_transform(range(0, k), lambda i: exp(-stat / 2 + i * ln(stat / 2) - lgamma(i + 1)))), 9) AS combined_p_value
  FROM (SELECT o_custkey, count(*) AS k, -2.0 * sum(ln({_P2})) AS stat FROM orders GROUP BY 1)""")
def fisher_by_customer(spark, folder):
    rows = samples.table(spark, folder, "orders").select("o_custkey", F.expr(_P2).cast("double").alias("raw_p_value"))
    out = inference.fisher(rows, ["o_custkey"])
    return out.select("o_custkey", "contributing_attempt_count", F.round("fisher_statistic", 6).alias("fisher_statistic"), "degrees_of_freedom", F.round("combined_p_value", 9).alias("combined_p_value"))


@query("equal_weight_means", """
  SELECT l_returnflag AS configuration_id, l_linestatus AS metric, 'aggregate' AS scope, count(*) FILTER (n > 5) AS contributing_attempt_count, round(avg(v) FILTER (n > 5), 6) AS value,
    CASE WHEN count(*) FILTER (n > 5) > 0 THEN 'COMPUTED' ELSE 'NOT_ESTIMABLE' END AS status, CASE WHEN count(*) FILTER (n > 5) = 0 THEN 'No estimable attempts' END AS insufficiency_reason
  FROM (SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def equal_weight_means(spark, folder):
    rows = samples.table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("_n")
    )
    rows = rows.select(
        F.col("l_returnflag").alias("configuration_id"), F.col("l_linestatus").alias("metric"), "value",
        F.when(F.col("_n") > 5, "COMPUTED").otherwise("NOT_ESTIMABLE").alias("status"),
    )
    return rounded(inference.equal_weight_mean(rows))


@query("complete_customers", """
  SELECT o_custkey AS attempt_id FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3""")
def complete_customers(spark, folder):
    rows = samples.table(spark, folder, "orders").select(F.col("o_custkey").alias("attempt_id"), F.lit("COMPUTED").alias("status"), F.col("o_orderstatus").alias("category"))
    return inference.complete_attempts(rows, "status", "category", ("F", "O", "P"))
