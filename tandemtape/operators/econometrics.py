"""Unit-root, vector-autoregression, cointegration and price-discovery estimates.

Spark sums the cross-products; one row per attempt and configuration then goes through a small matrix solve (at most
21 x 21).  No series is gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtape.functions.tails import f_tail_value, normal_cdf_value, normal_two_sided
from tandemtape.operators import moments
from tandemtape.operators.moments import WindowedGram, solve_scaled

KEYS = ["attempt_id", "configuration_id"]


@dataclass(frozen=True)
class ModelConfig:
    alpha: float = 0.05
    adf_max_lag: int = 12
    var_max_lag: int = 10
    irf_horizon: int = 20
    hac_lag: int = 1


# Published response-surface coefficients for the unit-root test with a constant (one series):
# normal-quantile polynomials below and above the switch point, and critical-value expansions in 1/n.
ADF_SWITCH = -1.61
ADF_RANGE = (-18.83, 2.74)
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# 95 % critical values of the trace statistic for two series with a constant.
TRACE_95 = (15.4943, 3.8415)
GG_FLOOR = 1e-12
VARIANCE_FLOOR = 1e-15


def adf_p_value(stat: float) -> float:
    low, high = ADF_RANGE
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    poly = ADF_LOW if stat <= ADF_SWITCH else ADF_HIGH
    return normal_cdf_value(sum(c * stat**k for k, c in enumerate(poly)))


def adf(g: WindowedGram, series: int, max_lag: int) -> dict:
    """Augmented Dickey-Fuller with a constant; lag by the lowest AIC on the common sample, then refitted."""

    def fit(lags: int, t0: int):
        base = [None] + [(series, a) for a in range(lags + 2)]
        whole = g.gram(base, t0)
        size = len(base)
        # Rows of the map: constant, level one back, lagged changes, change now.
        change = lambda a: np.eye(size)[1 + a] - np.eye(size)[2 + a]
        design = np.array([np.eye(size)[0], np.eye(size)[2], *[change(k) for k in range(1, lags + 1)]])
        target = change(0)
        xx, xy, yy = design @ whole @ design.T, design @ whole @ target, target @ whole @ target
        coef, inverse = solve_scaled(xx, xy)
        n, k = g.n - t0, len(coef)
        ssr = float(yy - coef @ xy)
        aic = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * k
        return aic, coef[1] / math.sqrt(ssr / (n - k) * inverse[1, 1]), n

    best = min(range(max_lag + 1), key=lambda k: (fit(k, max_lag + 1)[0], k))
    _, stat, n = fit(best, best + 1)
    critical = [sum(c / n**k for k, c in enumerate(line)) for line in ADF_CRITICAL.values()]
    return {"statistic": stat, "p_value": adf_p_value(stat), "lags": best, "observations": n, "critical": critical}


def var_terms(p: int) -> list:
    return [None] + [(i, a) for a in range(1, p + 1) for i in (1, 2)]


def var_fit(g: WindowedGram, p: int, t0: int, order: tuple[int, int] = (1, 2)):
    """Least squares of both series on a constant and p lags of both over t >= t0."""
    terms = [None] + [(i, a) for a in range(1, p + 1) for i in order]
    targets = [(i, 0) for i in order]
    whole = g.gram(terms + targets, t0)
    k = len(terms)
    xx, xy, yy = whole[:k, :k], whole[:k, k:], whole[k:, k:]
    coef, inverse = solve_scaled(xx, xy)
    residual = yy - coef.T @ xy
    return coef, inverse, (residual + residual.T) / 2, g.n - t0


def criteria(residual: np.ndarray, n: int, p: int) -> tuple[float, float, float]:
    log_det = math.log(np.linalg.det(residual / n))
    free = 4 * p + 2
    return (
        log_det + 2.0 / n * free,
        log_det + math.log(n) / n * free,
        log_det + 2.0 * math.log(math.log(n)) / n * free,
    )


def companion_moduli(coef: np.ndarray, p: int) -> np.ndarray:
    matrix = np.zeros((2 * p, 2 * p))
    matrix[:2] = coef[1:].T
    matrix[2:, :-2] = np.eye(2 * p - 2)
    return np.abs(np.linalg.eigvals(matrix))


def orthogonal_responses(coef: np.ndarray, sigma: np.ndarray, p: int, horizon: int) -> np.ndarray:
    steps = [coef[1 + 2 * k : 3 + 2 * k].T for k in range(p)]
    psi = [np.eye(2)]
    for h in range(1, horizon + 1):
        psi.append(sum(psi[h - 1 - k] @ steps[k] for k in range(min(p, h))))
    root = np.linalg.cholesky(sigma)
    return np.array([m @ root for m in psi])


def causality(coef: np.ndarray, inverse: np.ndarray, sigma: np.ndarray, p: int, n: int, caused: int, causing: int):
    """Wald F that the lags of ``causing`` have no part in the equation of ``caused`` (0-based series)."""
    picked = [1 + 2 * k + causing for k in range(p)]
    b = coef[picked, caused]
    cov = inverse[np.ix_(picked, picked)] * sigma[caused, caused]
    stat = float(b @ np.linalg.solve(cov, b)) / p
    d1, d2 = p, 2 * (n - 2 * p - 1)
    return stat, d1, d2, f_tail_value(stat, d1, d2)


def regression_start(g: WindowedGram) -> list[dict]:
    """Next-step regression of each series on both: coefficients and inverse Gram, per direction."""
    out = []
    for name, predictor, target in (("kraken_predicts_coinbase", 2, 1), ("coinbase_predicts_kraken", 1, 2)):
        terms = [None, (predictor, 1), (target, 1)]
        whole = g.gram(terms + [(target, 0)], 1)
        n = g.n - 1
        centred = whole[1, 1] - whole[0, 1] ** 2 / n
        if n > 5 and centred > 0:
            coef, inverse = solve_scaled(whole[:3, :3], whole[:3, 3])
            out.append({"direction": name, "coef": coef.tolist(), "inverse": inverse.ravel().tolist()})
    return out


RETURN_MODELS = (
    "attempt_id string, configuration_id string, n bigint, flat boolean,"
    "adf array<struct<venue:string,statistic:double,p_value:double,lags:int,observations:bigint,"
    "critical:array<double>,status:string>>,"
    "lag int, aic double, bic double, hqic double, coefficients array<double>, standard_errors array<double>,"
    "moduli array<double>, nobs bigint, stable boolean, fit_status string,"
    "granger array<struct<direction:string,statistic:double,df1:int,df2:bigint,p_value:double>>,"
    "irf array<struct<ordering:string,horizon:int,response:double>>,"
    "regressions array<struct<direction:string,coef:array<double>,inverse:array<double>>>"
)


def _return_models(config: ModelConfig):
    names = [part.split()[0] for part in _top_level(RETURN_MODELS)]

    def solve(row) -> dict:
        g = WindowedGram(row.n, row.sums, row.products, row.edge_pos, row.edge_1, row.edge_2)
        base = row.configuration_id == "baseline"
        order = (2, 1) if row.configuration_id == "kraken_first" else (1, 2)
        out = dict.fromkeys(names) | {
            "attempt_id": row.attempt_id, "configuration_id": row.configuration_id, "n": row.n, "flat": row.flat,
            "adf": [], "granger": [], "irf": [], "regressions": [], "fit_status": "MODEL_INVALID",
        }
        if base:
            for series, venue, flat in ((1, "coinbase", row.flat_1), (2, "kraken", row.flat_2)):
                try:
                    if flat:
                        raise ValueError("constant series")
                    line = adf(g, series, config.adf_max_lag)
                    out["adf"].append(line | {"venue": venue, "status": "COMPUTED"})
                except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
                    out["adf"].append(
                        {"venue": venue, "statistic": None, "p_value": None, "lags": None, "observations": row.n,
                         "critical": None, "status": "MODEL_INVALID"}
                    )
        if row.flat:
            return out
        try:
            scores = []
            for p in range(config.var_max_lag + 1):
                _, _, residual, n = var_fit(g, p, config.var_max_lag, order)
                scores.append(criteria(residual, n, p)[1])
            p = max(int(np.argmin(scores)), 1)
            coef, inverse, residual, n = var_fit(g, p, p, order)
            sigma = residual / (n - 2 * p - 1)
            moduli = companion_moduli(coef, p)
            stable = bool(np.all(np.isfinite(moduli)) and np.all(moduli < 1.0))
            aic, bic, hqic = criteria(residual, n, p)
            out |= {
                "lag": p, "aic": aic, "bic": bic, "hqic": hqic, "coefficients": coef.ravel().tolist(),
                "standard_errors": np.sqrt(np.outer(np.diag(inverse), np.diag(sigma))).ravel().tolist(),
                "moduli": sorted((moduli).tolist(), reverse=True), "nobs": n, "stable": stable,
                "fit_status": "COMPUTED" if stable else "UNSTABLE",
            }
            if stable and base:
                for name, caused, causing in (("coinbase_predicts_kraken", 1, 0), ("kraken_predicts_coinbase", 0, 1)):
                    stat, d1, d2, tail = causality(coef, inverse, sigma, p, n, caused, causing)
                    out["granger"].append({"direction": name, "statistic": stat, "df1": d1, "df2": d2, "p_value": tail})
                turned, _, other, _ = var_fit(g, p, p, (2, 1))
                for ordering, c, s, at in (
                    ("coinbase_first", coef, sigma, (1, 0)), ("kraken_first", turned, other / (n - 2 * p - 1), (0, 1)),
                ):
                    responses = orthogonal_responses(c, s, p, config.irf_horizon)
                    out["irf"] += [
                        {"ordering": ordering, "horizon": h, "response": float(m[at])} for h, m in enumerate(responses)
                    ]
        except (ValueError, np.linalg.LinAlgError):
            out["fit_status"] = "MODEL_INVALID"
        if base:
            out["regressions"] = regression_start(g)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([solve(row) for row in batch.itertuples(index=False)], columns=names)
            for c in ("lag", "nobs", "n"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return run


def _top_level(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def return_models(returns: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """All estimates that need only the returns' cross-products, one row per attempt and configuration."""
    products = moments.lag_products(returns, KEYS, max(config.adf_max_lag + 1, config.var_max_lag))
    return products.mapInPandas(_return_models(config), RETURN_MODELS)


def stationarity(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    rows = models.select("attempt_id", F.explode("adf").alias("a"))
    return rows.select(
        "attempt_id", "a.venue", F.lit("return").alias("series_type"), F.lit("ADF").alias("test_name"),
        F.col("a.statistic").alias("test_statistic"), "a.p_value", F.col("a.lags").alias("lags_used"),
        "a.observations", F.col("a.critical").alias("critical_values"),
        F.when(F.col("a.p_value").isNull(), "UNKNOWN").when(F.col("a.p_value") < alpha, "REJECT_NULL")
        .otherwise("FAIL_TO_REJECT").alias("decision"),
        "a.status",
    )


def var_table(models: DataFrame) -> DataFrame:
    base = models.where("configuration_id = 'baseline'")
    return base.select(
        "attempt_id", F.col("lag").alias("selected_lag"), "aic", "bic", "hqic", "coefficients", "standard_errors",
        F.coalesce("nobs", "n").alias("sample_count"), "fit_status", F.col("stable").alias("is_stable"),
        F.transform("moduli", lambda m: 1.0 / m).alias("roots"),
        F.when(F.col("lag").isNull(), "NOT_COMPUTED").otherwise("COMPUTED").alias("residual_diagnostic_status"),
    )


def granger(models: DataFrame) -> DataFrame:
    rows = models.select("attempt_id", "lag", "nobs", F.explode("granger").alias("g"))
    return rows.select(
        "attempt_id", "g.direction", F.col("lag").alias("lag_order"), F.col("g.statistic").alias("test_statistic"),
        F.array(F.col("g.df1").cast("bigint"), F.col("g.df2")).alias("degrees_of_freedom"),
        F.col("g.p_value").alias("raw_p_value"), F.col("nobs").alias("effective_sample_count"),
        F.lit("COMPUTED").alias("model_validity_status"),
    )


def impulse_responses(models: DataFrame) -> DataFrame:
    """Responses of venue 2 to a venue 1 shock with running sums; at most 21 rows per attempt and ordering."""
    rows = models.select("attempt_id", F.explode("irf").alias("r")).select("attempt_id", "r.*")
    by = Window.partitionBy("attempt_id", "ordering").orderBy("horizon")
    return rows.select(
        "attempt_id", F.lit("coinbase").alias("shock_venue"), F.lit("kraken").alias("response_venue"),
        "ordering", "horizon", "response", F.sum("response").over(by).alias("cumulative_response"),
        F.lit("COMPUTED").alias("model_status"),
    )


def predictive_regressions(returns: DataFrame, models: DataFrame) -> DataFrame:
    """Next-step regressions with Newey-West errors at lag 1 and normal p-values.

    A second pass over the rows sums the residual scores; the 3 x 3 sandwich is plain column arithmetic.
    """
    base = returns.where("configuration_id = 'baseline'")
    wide = moments.lagged(base, KEYS, 2).where("pos >= 1")
    fits = models.where("configuration_id = 'baseline'").select(*KEYS, F.explode("regressions").alias("f")).select(
        *KEYS, "f.*"
    )
    rows = wide.join(fits, KEYS)
    forward = F.col("direction") == "kraken_predicts_coinbase"
    pred = lambda k: F.when(forward, F.col(f"y2_{k}")).otherwise(F.col(f"y1_{k}"))
    own = lambda k: (
        F.when(forward, F.col("y1" if k == 0 else f"y1_{k}")).otherwise(F.col("y2" if k == 0 else f"y2_{k}"))
    )
    error = lambda k: own(k) - F.col("coef")[0] - F.col("coef")[1] * pred(k + 1) - F.col("coef")[2] * own(k + 1)
    scored = rows.select(
        *KEYS, "direction", "coef", "inverse", "n",
        *[(e * x).alias(f"g{k}_{m}") for k in (0, 1) for e in [error(k)]
          for m, x in enumerate((F.lit(1.0), pred(k + 1), own(k + 1)))],
    )
    sums = scored.groupBy(*KEYS, "direction").agg(
        F.first("coef").alias("coef"), F.first("inverse").alias("inv"), F.first("n").alias("n"),
        *[F.sum(F.col(f"g0_{a}") * F.col(f"g0_{b}")).alias(f"s_{a}{b}") for a in range(3) for b in range(3)],
        *[F.coalesce(F.sum(F.col(f"g0_{a}") * F.col(f"g1_{b}")), F.lit(0.0)).alias(f"t_{a}{b}")
          for a in range(3) for b in range(3)],
    )
    meat = lambda a, b: F.col(f"s_{a}{b}") + 0.5 * (F.col(f"t_{a}{b}") + F.col(f"t_{b}{a}"))
    inv = lambda a, b: F.col("inv")[3 * a + b]
    variance = sum(
        (inv(1, a) * meat(a, b) * inv(b, 1) for a in range(3) for b in range(3)), F.lit(0.0)
    )
    shaped = sums.select(
        "attempt_id", "direction", F.col("coef")[1].alias("coefficient"), F.sqrt(variance).alias("standard_error"),
        (F.col("n") - 1).alias("effective_sample_count"),
    ).withColumn("t_statistic", F.col("coefficient") / F.col("standard_error"))
    return shaped.select(
        "attempt_id", "direction", F.lit(1).alias("prediction_horizon"), F.lit(1).alias("predictor_lag"),
        "coefficient", "standard_error", "t_statistic", normal_two_sided("t_statistic").alias("raw_p_value"),
        "effective_sample_count", F.lit("COMPUTED").alias("fit_status"),
    )


LEVEL_MODELS = (
    "attempt_id string, configuration_id string, n bigint, trace array<double>, rank int,"
    "alpha array<double>, beta array<double>, sigma array<double>, failure string"
)


def _level_solve(row) -> dict:
    upper = np.asarray(row.products, dtype=float)
    full = np.zeros((6, 6))
    full[np.triu_indices(6)] = upper
    full = full + np.triu(full, 1).T
    t = float(row.rows)
    # Partial the lagged changes out of changes and levels.
    keep, out = [0, 1, 4, 5], [2, 3]
    _, inverse = solve_scaled(full[np.ix_(out, out)], np.eye(2))
    part = (full[np.ix_(keep, keep)] - full[np.ix_(keep, out)] @ inverse @ full[np.ix_(out, keep)]) / t
    s00, s01, s11 = part[:2, :2], part[:2, 2:], part[2:, 2:]
    root = np.linalg.cholesky(s11)
    left = np.linalg.inv(root)
    core = left @ s01.T @ np.linalg.solve(s00, s01) @ left.T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    tail = np.log1p(-values)
    trace = [float(-t * tail.sum()), float(-t * tail[1])]
    rank = 0 if trace[0] <= TRACE_95[0] else 1 if trace[1] <= TRACE_95[1] else 2
    result = {"trace": trace, "rank": rank, "alpha": None, "beta": None, "sigma": None, "failure": None}
    if rank == 1:
        vector = left.T @ vectors[:, 0]
        if vector[0] == 0:
            return result | {"failure": "VECM_FIT_FAILED"}
        beta = vector / vector[0]
        alpha = s01 @ beta / float(beta @ s11 @ beta)
        sigma = s00 - np.outer(alpha, s01 @ beta) - np.outer(s01 @ beta, alpha) + np.outer(alpha, alpha) * float(
            beta @ s11 @ beta
        )
        result |= {"alpha": alpha.tolist(), "beta": beta.tolist(), "sigma": sigma.ravel().tolist()}
    return result


def _level_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            line = {"attempt_id": row.attempt_id, "configuration_id": row.configuration_id, "n": row.n}
            try:
                line |= _level_solve(row)
            except (ValueError, np.linalg.LinAlgError):
                line |= {"trace": None, "rank": None, "alpha": None, "beta": None, "sigma": None, "failure": "JOHANSEN_FAILED"}
            rows.append(line)
        names = [p.split()[0] for p in _top_level(LEVEL_MODELS)]
        frame = pd.DataFrame(rows, columns=names)
        frame["rank"] = frame["rank"].astype("Int64")
        yield frame


def level_models(levels: DataFrame) -> DataFrame:
    """Trace statistics, rank and, for rank one, adjustment, cointegrating vector and innovation covariance."""
    return moments.level_moments(levels, KEYS).mapInPandas(_level_models, LEVEL_MODELS)


def cointegration(levels: DataFrame) -> DataFrame:
    """Cointegration table with status and reason."""
    models = levels
    reason = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("rank") != 1, "COINTEGRATION_RANK_NOT_ONE")
    return models.select(
        "attempt_id", F.col("n").alias("observations"), F.lit("co").alias("deterministic_specification"),
        F.lit(1).alias("lag_order"), F.col("trace").alias("johansen_trace_statistics"),
        F.array(*[F.lit(v) for v in TRACE_95]).alias("critical_values"),
        F.col("rank").alias("inferred_cointegration_rank"),
        F.when(F.col("failure").isNotNull(), "MODEL_INVALID").when(F.col("rank") == 1, "ESTIMABLE")
        .otherwise("NOT_ESTIMABLE").alias("vecm_status"),
        F.col("alpha").alias("adjustment_coefficients"), F.col("beta").alias("cointegrating_vector"),
        F.when(F.col("failure").isNotNull(), "MODEL_INVALID").otherwise("COMPUTED").alias("residual_status"),
        reason.alias("insufficiency_reason"), F.col("sigma").alias("innovation_covariance"),
    )


def component_shares(a1: Column, a2: Column) -> tuple[Column, Column]:
    """Permanent-component weights (-a2, a1) / (a1 - a2); null where the sum vanishes."""
    total = a1 - a2
    sound = F.abs(total) > GG_FLOOR
    return F.when(sound, -a2 / total), F.when(sound, a1 / total)


def information_bounds(a1: Column, a2: Column, s11: Column, s12: Column, s22: Column):
    """Lower and upper information shares over both Cholesky orderings; null when the covariance is unfit.

    With weights (w1, w2) = (-a2, a1), the first venue of an ordering is credited with the shared part.
    """
    w1, w2 = -a2, a1
    total = w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22
    det = s11 * s22 - s12 * s12
    sound = (s11 > 0) & (s22 > 0) & (det > 0) & (total > VARIANCE_FLOOR)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    first_1 = clip((w1 * s11 + w2 * s12) * (w1 * s11 + w2 * s12) / s11 / total)
    last_1 = clip(w1 * w1 * (det / s22) / total)
    first_2 = clip((w2 * s22 + w1 * s12) * (w2 * s22 + w1 * s12) / s22 / total)
    last_2 = clip(w2 * w2 * (det / s11) / total)
    pairs = (F.least(first_1, last_1), F.greatest(first_1, last_1), F.least(first_2, last_2), F.greatest(first_2, last_2))
    return tuple(F.when(sound, p) for p in pairs)


def price_discovery(coint: DataFrame) -> DataFrame:
    """Two result rows per attempt: component shares and information-share bounds, with status and reason."""
    a1, a2 = F.col("adjustment_coefficients")[0], F.col("adjustment_coefficients")[1]
    s = F.col("innovation_covariance")
    cb, kr = component_shares(a1, a2)
    lo1, up1, lo2, up2 = information_bounds(a1, a2, s[0], s[1], s[3])
    fitted = coint.where("vecm_status = 'ESTIMABLE'")
    null = F.lit(None).cast("double")
    line = lambda metric, v1, v2, l1, u1, l2, u2, ok, why: F.struct(
        F.lit(metric).alias("metric"), v1.alias("coinbase_value"), v2.alias("kraken_value"),
        l1.alias("coinbase_lower"), u1.alias("coinbase_upper"), l2.alias("kraken_lower"), u2.alias("kraken_upper"),
        F.when(ok, "COMPUTED").otherwise("NOT_ESTIMABLE").alias("status"),
        F.when(~ok, why).alias("insufficiency_reason"),
    )
    computed = fitted.select(
        "attempt_id", "inferred_cointegration_rank", "observations",
        F.explode(
            F.array(
                line("GONZALO_GRANGER_COMPONENT_SHARE", cb, kr, cb, cb, kr, kr, cb.isNotNull(), "GG_ILL_CONDITIONED"),
                line("HASBROUCK_INFORMATION_SHARE", null, null, lo1, up1, lo2, up2, lo1.isNotNull(), "HASBROUCK_COVARIANCE_INVALID"),
            )
        ).alias("r"),
    )
    missing = coint.where("vecm_status <> 'ESTIMABLE'").select(
        "attempt_id", "inferred_cointegration_rank", "observations",
        F.explode(
            F.transform(
                F.array(F.lit("GONZALO_GRANGER_COMPONENT_SHARE"), F.lit("HASBROUCK_INFORMATION_SHARE")),
                lambda m: F.struct(
                    m.alias("metric"), *[null.alias(c) for c in (
                        "coinbase_value", "kraken_value", "coinbase_lower", "coinbase_upper", "kraken_lower", "kraken_upper",
                    )],
                    F.lit("NOT_ESTIMABLE").alias("status"), F.col("insufficiency_reason").alias("insufficiency_reason"),
                ),
            )
        ).alias("r"),
    )
    return computed.unionAll(missing).select(
        "attempt_id", "r.metric", "r.coinbase_value", "r.kraken_value", "r.coinbase_lower", "r.coinbase_upper",
        "r.kraken_lower", "r.kraken_upper", F.col("inferred_cointegration_rank").alias("cointegration_rank"),
        F.col("observations").alias("effective_sample_count"), "r.status", "r.insufficiency_reason",
    )


def stability(diagnostics: DataFrame, models: DataFrame, specs, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Robustness row per attempt and configuration: 1 when the autoregression is strictly stable.

    A failed fit is not estimable; the effective sample is always the longest run.
    """
    named = F.create_map(*[x for s in specs for x in (F.lit(s.name), F.struct(F.lit(s.trim_policy).alias("t"), F.lit(s.ordering).alias("o")))])
    joined = diagnostics.join(models.select(*KEYS, "flat", "stable", "fit_status"), KEYS, "left")
    fitted = (F.col("status") == "COMPUTED") & F.col("stable").isNotNull()
    return joined.select(
        "configuration_id", F.lit("per_attempt").alias("scope"), "attempt_id", "sampling_interval_ms", "return_horizon_ms",
        F.lit(config.var_max_lag).alias("max_var_lag"), named[F.col("configuration_id")]["t"].alias("trim_policy"),
        named[F.col("configuration_id")]["o"].alias("ordering"), F.col("longest_return_run").alias("effective_sample_count"),
        F.col("usable_return_pairs"), F.lit("VAR_STABILITY").alias("metric"),
        F.when(fitted, F.col("stable").cast("double")).alias("value"),
        F.when(fitted, "COMPUTED").otherwise("NOT_ESTIMABLE").alias("status"),
        F.when(~fitted, F.coalesce("insufficiency_reason", F.when(F.col("flat"), "Zero variance").otherwise("VAR fit failed")))
        .alias("insufficiency_reason"),
    )
