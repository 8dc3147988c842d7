"""Queries over ticks: overlap, lattice, as-of, spreads, descriptives, lead-lag, robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators import descriptive, leadlag, sync
from tandemtape.plans.registry import block, query, rounded, using
from tandemtape.sources import samples

# The test ticks arrive minutes apart, so every clock is stretched by this factor.
UNIT = 6000
CONFIG = sync.SyncConfig(
    sampling_ms=100 * UNIT, tolerance_ms=50 * UNIT, stale_ms=3_600_000, trim_ms=7_200_000, horizon_ms=100 * UNIT, spread_threshold_bps=500.0
)
STEP, TRIM, STALE, TOL = 600_000_000, 7_200_000_000, 3_600_000.0, 300_000.0

block("bounds", """
  SELECT attempt_id, max(s) AS start_us, min(e) AS end_us FROM
    (SELECT attempt_id, venue, min(ts_us) AS s, max(ts_us) AS e FROM ticks GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2 AND max(s) < min(e)""")
block("q1", "SELECT attempt_id, ts_us, arg_max((bid_price + ask_price) / 2.0, record_index) AS mid FROM ticks WHERE venue = 'coinbase' GROUP BY 1, 2")
block("q2", "SELECT attempt_id, ts_us, arg_max((bid_price + ask_price) / 2.0, record_index) AS mid FROM ticks WHERE venue = 'kraken' GROUP BY 1, 2")


def grid_sql(step: int, trim: int, a: str = "q1", b: str = "q2") -> str:
    text = f"""
  SELECT a.attempt_id, a.cell, a.anchor_us, a.start_us, a.end_us, q1.ts_us AS cb_ts_us, q1.mid AS cb_mid, q2.ts_us AS kr_ts_us, q2.mid AS kr_mid,
    (a.anchor_us - q1.ts_us) / 1000.0 AS cb_age_ms, (a.anchor_us - q2.ts_us) / 1000.0 AS kr_age_ms,
    q1.mid - q2.mid AS signed_spread, abs(q1.mid - q2.mid) AS absolute_spread, (q1.mid - q2.mid) / q2.mid * 10000 AS signed_spread_bps
  FROM (SELECT attempt_id, cell, start_us + {trim} + cell * {step} AS anchor_us, start_us + {trim} AS start_us, end_us - {trim} AS end_us
        FROM (SELECT *, unnest(generate_series(0, (end_us - start_us - 2 * {trim}) // {step})) AS cell FROM bounds WHERE end_us - {trim} > start_us + {trim})) a
  ASOF LEFT JOIN q1 ON a.attempt_id = q1.attempt_id AND a.anchor_us >= q1.ts_us
  ASOF LEFT JOIN q2 ON a.attempt_id = q2.attempt_id AND a.anchor_us >= q2.ts_us"""
    return text.replace("q1", a).replace("q2", b)


def reason_sql(stale: float, tol: float, enforce: bool) -> str:
    extra = f"WHEN cb_age_ms > {tol} OR kr_age_ms > {tol} THEN 'ALIGNMENT_TOLERANCE_EXCEEDED'" if enforce else ""
    return f"CASE WHEN cb_age_ms > {stale} THEN 'COINBASE_STALE' WHEN kr_age_ms > {stale} THEN 'KRAKEN_STALE' {extra} ELSE 'none' END"


block("grid", grid_sql(STEP, TRIM))
block("judged", f"""SELECT *, {reason_sql(STALE, TOL, False)} AS rejection_reason, cb_age_ms > {STALE} OR kr_age_ms > {STALE} AS is_stale FROM grid""")
block("fine", grid_sql(300_000_000, 0))
GRID = "base ticks bounds q1 q2 grid judged"


def ticks(spark, folder) -> DataFrame:
    return samples.ticks(spark, folder)


def grid(spark, folder) -> DataFrame:
    rows = ticks(spark, folder)
    return sync.synchronize(rows, sync.overlap(rows), CONFIG)


@query("venue_overlap", using("base ticks bounds", """
  SELECT attempt_id, start_us, end_us, round((end_us - start_us) / 1e6, 6) AS overlap_seconds FROM bounds"""))
def venue_overlap(spark, folder):
    return rounded(sync.overlap(ticks(spark, folder)))


@query("synchronized_grid", using(GRID, """
  SELECT attempt_id, cell, anchor_us, cb_ts_us, kr_ts_us, round(cb_age_ms, 3) + 0.0 AS cb_age_ms, round(kr_age_ms, 3) + 0.0 AS kr_age_ms,
    round(signed_spread, 6) + 0.0 AS signed_spread, round(signed_spread_bps, 6) + 0.0 AS signed_spread_bps, rejection_reason, is_stale FROM judged"""))
def synchronized_grid(spark, folder):
    rows = grid(spark, folder).select("attempt_id", "cell", "anchor_us", "cb_ts_us", "kr_ts_us", "signed_spread", "signed_spread_bps", "rejection_reason", "is_stale", "cb_age_ms", "kr_age_ms")
    return rounded(rows)


@query("strict_freshness_grid", using("base ticks bounds q1 q2 grid", f"""
  SELECT attempt_id, {reason_sql(STALE, TOL, True)} AS rejection_reason, count(*) AS points, count(cb_mid) AS with_venue_1 FROM grid GROUP BY 1, 2"""))
def strict_freshness_grid(spark, folder):
    from dataclasses import replace

    rows = ticks(spark, folder)
    out = sync.synchronize(rows, sync.overlap(rows), replace(CONFIG, enforce_tolerance=True))
    return out.groupBy("attempt_id", "rejection_reason").agg(F.count(F.lit(1)).alias("points"), F.count("cb_mid").alias("with_venue_1"))


_MOMENTS = """count(*) AS candidate_count, count(*) FILTER (ok) AS accepted_count, count(*) FILTER (NOT ok) AS rejected_count, count(*) FILTER (is_stale) AS stale_count,
  count(*) FILTER (ok AND (cb_mid IS NULL OR kr_mid IS NULL)) AS no_quote_count,
  round(avg(signed_spread) FILTER (ok), 6) + 0.0 AS mean_signed_spread, round(stddev_samp(signed_spread) FILTER (ok), 6) AS std_signed_spread,
  round(min(signed_spread) FILTER (ok), 6) + 0.0 AS minimum_signed_spread, round(max(signed_spread) FILTER (ok), 6) + 0.0 AS maximum_signed_spread,
  round(avg(absolute_spread) FILTER (ok), 6) AS mean_absolute_spread, round(avg(signed_spread_bps) FILTER (ok), 6) + 0.0 AS mean_signed_spread_bps,
  round(avg(abs(signed_spread_bps)) FILTER (ok), 6) AS mean_absolute_spread_bps,
  count(*) FILTER (ok AND signed_spread > 0) AS positive_frequency, count(*) FILTER (ok AND signed_spread < 0) AS negative_frequency,
  count(*) FILTER (ok AND signed_spread = 0) AS zero_frequency"""
_OK = "(SELECT *, rejection_reason = 'none' AS ok FROM judged)"


@query("spread_per_attempt", using(GRID, f"SELECT attempt_id, {_MOMENTS} FROM {_OK} GROUP BY 1"))
def spread_per_attempt(spark, folder):
    return rounded(sync.spread_rows(grid(spark, folder), ["attempt_id"]))


@query("spread_statistics", using(GRID, f"""
  SELECT attempt_id, {_MOMENTS}, round(median(signed_spread) FILTER (ok), 6) + 0.0 AS median_signed_spread, 'per_attempt' AS scope, 'canonical' AS result_label,
    'baseline' AS configuration_id, 1 AS contributing_attempt_count FROM {_OK} GROUP BY attempt_id
  UNION ALL BY NAME
  SELECT 'ALL' AS attempt_id, {_MOMENTS}, round(median(signed_spread) FILTER (ok), 6) + 0.0 AS median_signed_spread, 'pooled' AS scope, 'EXPLORATORY' AS result_label,
    'baseline' AS configuration_id, count(DISTINCT attempt_id) AS contributing_attempt_count FROM {_OK}"""))
def spread_statistics(spark, folder):
    return rounded(sync.spread_statistics(grid(spark, folder), CONFIG))


@query("accepted_spread_description", using(GRID, """
  SELECT attempt_id, count(signed_spread_bps) AS "count", round(avg(signed_spread_bps), 6) + 0.0 AS mean, round(stddev_samp(signed_spread_bps), 6) AS std,
    round(min(signed_spread_bps), 6) + 0.0 AS min, round(max(signed_spread_bps), 6) + 0.0 AS max, round(median(signed_spread_bps), 6) + 0.0 AS median,
    round(list_sort(list(signed_spread_bps))[1 + CAST(round((count(signed_spread_bps) - 1) * 0.25) AS BIGINT)], 6) + 0.0 AS p25,
    round(list_sort(list(signed_spread_bps))[1 + CAST(round((count(signed_spread_bps) - 1) * 0.75) AS BIGINT)], 6) + 0.0 AS p75,
    count(*) FILTER (signed_spread_bps > 0) AS positive_count, count(*) FILTER (signed_spread_bps < 0) AS negative_count,
    count(*) FILTER (signed_spread_bps = 0) AS zero_count, count(*) FILTER (abs(signed_spread_bps) > 500) AS breach_count
  FROM judged WHERE rejection_reason = 'none' AND signed_spread_bps IS NOT NULL GROUP BY 1"""))
def accepted_spread_description(spark, folder):
    rows = grid(spark, folder).where("NOT is_rejected AND signed_spread_bps IS NOT NULL")
    return rounded(descriptive.describe_spread(rows, ["attempt_id"], "signed_spread_bps", CONFIG.spread_threshold_bps))


def _design_sql() -> str:
    parts = []
    for c in sync.designs(CONFIG, UNIT):
        every, trim = c.sampling_ms // 300_000, c.trim_ms // 300_000
        parts.append(f"""SELECT '{c.name}' AS configuration_id, CAST({c.sampling_ms} AS BIGINT) AS sampling_interval_ms, CAST({c.tolerance_ms} AS BIGINT) AS alignment_tolerance_ms,
          CAST({c.stale_ms} AS BIGINT) AS stale_threshold_ms, CAST({c.trim_ms} AS BIGINT) AS trim_ms, attempt_id, {reason_sql(c.stale_ms, c.tolerance_ms, c.enforce_tolerance)} = 'none' AS ok, signed_spread
          FROM fine WHERE cell >= {trim} AND (cell - {trim}) % {every} = 0 AND anchor_us <= end_us - {c.trim_ms * 1000} AND end_us - {c.trim_ms * 1000} > start_us + {c.trim_ms * 1000}""")
    return " UNION ALL ".join(parts)


block("designs", _design_sql())
_LABELS = "configuration_id, sampling_interval_ms, alignment_tolerance_ms, stale_threshold_ms, trim_ms"


@query("robustness_designs", using("base ticks bounds q1 q2 fine designs", f"""
  SELECT {_LABELS}, 'per_attempt' AS scope, attempt_id, count(*) AS candidate_count, count(*) FILTER (ok) AS accepted_count, 1 AS contributing_attempt_count,
    round(avg(signed_spread) FILTER (ok), 6) + 0.0 AS spread_metric FROM designs GROUP BY ALL
  UNION ALL SELECT {_LABELS}, 'pooled', 'ALL', count(*), count(*) FILTER (ok), count(DISTINCT attempt_id), round(avg(signed_spread) FILTER (ok), 6) + 0.0 FROM designs GROUP BY ALL"""))
def robustness_designs(spark, folder):
    rows = ticks(spark, folder)
    return rounded(sync.robustness(rows, sync.overlap(rows), sync.designs(CONFIG, UNIT)))


# --- descriptives ----------------------------------------------------------------------------------------------------
block("moved", """
  SELECT *, ln(price) - ln(lag(price) OVER w) AS log_return, (ts_us - lag(ts_us) OVER w) / 1000.0 AS gap_ms
  FROM ticks WINDOW w AS (PARTITION BY attempt_id, venue ORDER BY record_index)""")


def near(c: str, q: float) -> str:
    return f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[1 + CAST(round((count({c}) - 1) * {q}) AS BIGINT)]"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


_STATS = ",\n".join([
    "count(*) AS trade_count", "count(price) AS trade_price_count", _r("avg(price)", "trade_price_mean"), _r("median(price)", "trade_price_median"),
    _r("stddev_samp(price)", "trade_price_std"), _r("min(price)", "trade_price_min"), _r("max(price)", "trade_price_max"),
    *[_r(near("price", q), f"trade_price_p{n}") for q, n in ((0.25, 25), (0.75, 75), (0.95, 95))],
    "count(log_return) AS log_return_count", _r("avg(log_return)", "log_return_mean"), _r("stddev_samp(log_return)", "log_return_std"),
    *[_r(near("log_return", q), f"log_return_p{n}") for q, n in ((0.25, 25), (0.5, 50), (0.75, 75))],
    _r("avg(abs(log_return))", "absolute_return_mean"), _r("median(abs(log_return))", "absolute_return_median"),
    *[_r(near("abs(log_return)", q), f"absolute_return_p{n}") for q, n in ((0.75, 75), (0.95, 95))],
    _r("sqrt(sum(log_return * log_return))", "realized_volatility"), "'sqrt(sum(log_return^2))' AS realized_volatility_definition",
    "count(quantity) AS trade_size_count", _r("avg(quantity)", "trade_size_mean"), _r("median(quantity)", "trade_size_median"), _r("stddev_samp(quantity)", "trade_size_std"),
    *[_r(near("quantity", q), f"trade_size_p{n}") for q, n in ((0.25, 25), (0.75, 75), (0.95, 95))],
    *[x for p in ("trade", "quote") for x in (
        f"count(gap_ms) AS {p}_interarrival_count", _r("avg(gap_ms)", f"{p}_interarrival_mean_ms"), _r("median(gap_ms)", f"{p}_interarrival_median_ms"),
        _r(near("gap_ms", 0.95), f"{p}_interarrival_p95_ms"), _r("count(*) / ((max(ts_us) - min(ts_us)) / 1e6)", f"{p}_intensity_per_second"))],
    "count(*) AS quote_count",
])


@query("attempt_descriptives", using("base ticks bounds moved", f"""
  SELECT m.*, start_us AS empirical_overlap_start_us, end_us AS empirical_overlap_end_us, round((end_us - start_us) / 1e6, 6) AS untrimmed_overlap_seconds,
    start_us + {TRIM} AS trimmed_start_us, end_us - {TRIM} AS trimmed_end_us, round((end_us - start_us - 2 * {TRIM}) / 1e6, 6) AS trimmed_usable_seconds
  FROM (SELECT attempt_id, venue, {_STATS} FROM moved GROUP BY 1, 2) m LEFT JOIN bounds USING (attempt_id)"""))
def attempt_descriptives(spark, folder):
    rows = ticks(spark, folder)
    return rounded(descriptive.attempt_statistics(rows, rows, sync.overlap(rows), CONFIG.trim_ms))


@query("tick_returns", using("base ticks moved", """
  SELECT record_index, attempt_id, venue, round(log_return, 9) + 0.0 AS log_return FROM moved"""))
def tick_returns(spark, folder):
    rows = descriptive.log_returns(ticks(spark, folder), ["attempt_id", "venue"])
    return rounded(rows.select("record_index", "attempt_id", "venue", "log_return"), 9)


@query("sorted_interarrival", using("base ticks", """
  SELECT attempt_id, venue, count(gap) AS interarrival_count, round(median(gap), 6) AS median_interarrival_ms FROM
    (SELECT *, (receipt_us - lag(receipt_us) OVER (PARTITION BY attempt_id, venue ORDER BY receipt_us)) / 1000.0 AS gap FROM ticks) GROUP BY 1, 2"""))
def sorted_interarrival(spark, folder):
    return rounded(descriptive.sorted_interarrival_median(ticks(spark, folder), ["attempt_id", "venue"], "receipt_us"))


@query("price_order_statistics", """
  SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(median(o_totalprice), 4) AS middle,
    round(list_sort(list(o_totalprice))[1 + CAST(round((count(*) - 1) * 0.95) AS BIGINT)], 4) AS nearest_95,
    round(list_sort(list(o_totalprice))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT)], 4) AS half_even_95,
    round(list_sort(list(o_totalprice))[1 + CAST(ceil((count(*) - 1) * 0.95) AS BIGINT)], 4) AS next_95 FROM orders GROUP BY 1, 2""")
def price_order_statistics(spark, folder):
    rows = samples.table(spark, folder, "orders")
    picks = {"middle": ("linear", 0.5), "nearest_95": ("nearest", 0.95), "half_even_95": ("round_even", 0.95), "next_95": ("ceil", 0.95)}
    return rounded(exact_quantiles(rows, ["o_orderpriority", "o_orderstatus"], "o_totalprice", picks), 4)


@query("quantity_description", """
  SELECT l_returnflag, count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
    min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(median(l_extendedprice), 4) AS median,
    round(list_sort(list(l_extendedprice))[1 + CAST(round((count(*) - 1) * 0.25) AS BIGINT)], 4) AS p25,
    round(list_sort(list(l_extendedprice))[1 + CAST(round((count(*) - 1) * 0.75) AS BIGINT)], 4) AS p75 FROM lineitem GROUP BY 1""")
def quantity_description(spark, folder):
    return rounded(descriptive.describe(samples.table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice"), 4)


# --- lead-lag --------------------------------------------------------------------------------------------------------
block("rets", """
  SELECT *, ln(cb_mid) - lag(ln(cb_mid)) OVER w AS x, ln(kr_mid) - lag(ln(kr_mid)) OVER w AS y,
    rejection_reason = 'none' AND coalesce(lag(rejection_reason) OVER w = 'none', false) AS ok
  FROM judged WINDOW w AS (PARTITION BY attempt_id ORDER BY cell)""")


def _lag_sql(negative: str) -> str:
    parts = []
    for lag in leadlag.LAGS_MS:
        s = abs(lag) // 100
        if lag > 0:
            x, y, v = f"lead(x, {s}) OVER w", "y", f"ok AND coalesce(lead(ok, {s}) OVER w, false)"
        elif lag < 0:
            x, y, v = "x", f"{negative}(y, {s}) OVER w", f"ok AND coalesce({negative}(ok, {s}) OVER w, false)"
        else:
            x, y, v = "x", "y", "ok"
        parts.append(f"""SELECT attempt_id, CAST({lag * UNIT} AS BIGINT) AS lag, {x} AS a, {y} AS b, {v} AS v FROM rets WINDOW w AS (PARTITION BY attempt_id ORDER BY cell)""")
    return f"""
  SELECT attempt_id, CAST(600000 AS BIGINT) AS sampling_interval_ms, CAST(600000 AS BIGINT) AS return_horizon_ms, lag,
    CASE WHEN lag > 0 THEN 'kraken_leads_coinbase' WHEN lag < 0 THEN 'coinbase_leads_kraken' ELSE 'contemporaneous' END AS direction,
    round(corr(a, b), 6) + 0.0 AS correlation, count(*) AS effective_sample_count, 'COMPUTED' AS status
  FROM ({' UNION ALL '.join(parts)}) WHERE v AND a IS NOT NULL AND b IS NOT NULL GROUP BY attempt_id, lag"""


@query("lead_lag_correlations", using(GRID + " rets", _lag_sql("lead")))
def lead_lag_correlations(spark, folder):
    return rounded(leadlag.lead_lag(grid(spark, folder), CONFIG, [lag * UNIT for lag in leadlag.LAGS_MS]))


@query("lead_lag_as_published", using(GRID + " rets", _lag_sql("lag")))
def lead_lag_as_published(spark, folder):
    return rounded(leadlag.lead_lag(grid(spark, folder), CONFIG, [lag * UNIT for lag in leadlag.LAGS_MS], as_published=True))


block("acc", """
  SELECT *, lag(dc) OVER w AS pc, lag(dk) OVER w AS pk FROM (
    SELECT attempt_id, cell, cb_mid - lag(cb_mid) OVER w AS dc, kr_mid - lag(kr_mid) OVER w AS dk FROM judged WHERE rejection_reason = 'none'
    WINDOW w AS (PARTITION BY attempt_id ORDER BY cell)) WINDOW w AS (PARTITION BY attempt_id ORDER BY cell)""")


@query("price_change_leaders", using(GRID + " acc", """
  SELECT attempt_id, cf AS coinbase_first_count, kf AS kraken_first_count, s AS simultaneous_count, CAST(0 AS BIGINT) AS unresolved_count,
    round(cr / nullif(cf, 0), 6) AS coinbase_first_directional_response, round(kr / nullif(kf, 0), 6) AS kraken_first_directional_response,
    CAST(600000 AS BIGINT) AS response_horizon_ms, n AS effective_sample_count
  FROM (SELECT attempt_id, count(*) AS n, count(*) FILTER (dc <> 0 AND dk = 0) AS cf, count(*) FILTER (dk <> 0 AND dc = 0) AS kf, count(*) FILTER (dc <> 0 AND dk <> 0) AS s,
    count(*) FILTER (pc <> 0 AND pk = 0 AND dk <> 0 AND pc * dk > 0) AS cr, count(*) FILTER (pk <> 0 AND pc = 0 AND dc <> 0 AND pk * dc > 0) AS kr FROM acc GROUP BY 1) WHERE n > 10"""))
def price_change_leaders(spark, folder):
    return rounded(leadlag.leaders(grid(spark, folder), CONFIG))
