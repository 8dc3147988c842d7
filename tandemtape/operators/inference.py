"""Multiple testing, combined inference, aggregation over attempts and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtape.functions.tails import chi2_tail_even
from tandemtape.operators.scans import ROWS, scan
from tandemtape.session import cut

# Categories and labels of the result tables.
DIRECTIONS = ("coinbase_predicts_kraken", "kraken_predicts_coinbase")
GG, HASBROUCK = "GONZALO_GRANGER_COMPONENT_SHARE", "HASBROUCK_INFORMATION_SHARE"


def usable_p(p: Column) -> Column:
    return F.coalesce(p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))


def false_discovery(tests: DataFrame, alpha: float = 0.05, p: str = "raw_p_value", family: Sequence[str] = (), slice_rows: int = ROWS) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over each whole family.

    adjusted = running minimum, from the largest p down, of p * m / rank.  Equal p-values first collapse to one row with
    a count; ranks and the running minimum then come from scans over slices of counted rows, so a family may be of any size and shape.
    """
    fam = [*family] or ["_family"]
    rows = tests if family else tests.withColumn("_family", F.lit("all"))
    values = rows.where(usable_p(F.col(p))).groupBy(*fam, p).agg(F.count(F.lit(1)).alias("_n"))
    # The logarithm to fifteen places keeps the order and hardly any two p-values share it.
    place = F.floor(F.ln(F.greatest(F.col(p), F.lit(1e-320))) * 1e15).cast("bigint")
    ranked = scan(cut(values.withColumn("_at", place)), fam, ["_at", p], sums={"_rank": F.col("_n")}, totals={"_m": F.col("_n")}, rows=slice_rows)
    scaled = cut(ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank")))
    adjusted = scan(scaled, fam, ["_at", p], lows={"_later": F.col("_raw")}, rows=slice_rows).select(
        *fam, p, F.least("_raw", "_later", F.lit(1.0)).alias("adjusted_p_value")
    )
    out = rows.join(adjusted, [*fam, p], "left")
    decided = out.withColumn(
        "decision",
        F.when(F.col("adjusted_p_value") <= alpha, "REJECT_NULL").when(F.col("adjusted_p_value").isNotNull(), "FAIL_TO_REJECT")
        .otherwise("UNKNOWN"),
    ).withColumns({"alpha": F.lit(alpha), "multiple_testing_method": F.lit("fdr_bh")})
    return decided.select(*tests.columns, "adjusted_p_value", "decision", "alpha", "multiple_testing_method")


def fisher(tests: DataFrame, keys: Sequence[str], p: str = "raw_p_value") -> DataFrame:
    """Fisher combination per key over usable p-values: statistic, degrees of freedom, combined p."""
    at = F.col(p)
    ok = usable_p(at)
    sums = tests.groupBy(*keys).agg(
        F.count_if(ok).alias("contributing_attempt_count"),
        F.count_if(ok & (at == 0)).alias("_zeros"),
        F.sum(F.when(ok & (at > 0), F.ln(at))).alias("_logs"),
    )
    k = F.col("contributing_attempt_count")
    stat = F.when(F.col("_zeros") > 0, F.lit(float("inf"))).otherwise(-2.0 * F.col("_logs"))
    return sums.select(
        *keys, "contributing_attempt_count",
        F.when(k > 0, stat).alias("fisher_statistic"), F.when(k > 0, 2 * k).alias("degrees_of_freedom"),
    ).withColumn(
        "combined_p_value",
        F.when(F.col("fisher_statistic").isNotNull(), chi2_tail_even(F.col("fisher_statistic"), F.col("degrees_of_freedom"))),
    )


def aggregate_inference(granger: DataFrame, regressions: DataFrame) -> DataFrame:
    """Two analyses by two directions; a cell without a usable p-value is reported as not estimable."""
    tests = granger.select(
        F.lit("granger_causality").alias("analysis"), "direction",
        F.when(F.col("model_validity_status") == "COMPUTED", F.col("raw_p_value")).alias("raw_p_value"),
    ).unionAll(
        regressions.select(
            F.lit("predictive_regression"), "direction",
            F.when(F.col("fit_status") == "COMPUTED", F.col("raw_p_value")),
        )
    )
    session = granger.sparkSession
    cells = session.createDataFrame(
        [(a, d, None) for a in ("granger_causality", "predictive_regression") for d in DIRECTIONS],
        "analysis string, direction string, raw_p_value double",
    )
    combined = fisher(tests.unionAll(cells), ["analysis", "direction"])
    some = F.col("contributing_attempt_count") > 0
    return combined.select(
        "analysis", F.lit("baseline").alias("specification_id"), "direction", F.lit("aggregate").alias("scope"),
        F.lit("fisher").alias("combination_method"), F.lit("raw_p_value").alias("p_value_source"),
        "contributing_attempt_count", "fisher_statistic", "degrees_of_freedom", "combined_p_value",
        F.when(some, "COMPUTED").otherwise("NOT_ESTIMABLE").alias("status"),
        F.when(~some, "No estimable attempt p-values").alias("insufficiency_reason"),
    )


def equal_weight_mean(rows: DataFrame, keys: Sequence[str] = ("configuration_id", "metric"), value: str = "value") -> DataFrame:
    """Mean over attempts with equal weight; only computed finite values count."""
    at = F.col(value)
    good = (F.col("status") == "COMPUTED") & at.isNotNull() & ~F.isnan(at) & (F.abs(at) != float("inf"))
    out = rows.groupBy(*keys).agg(
        F.count_if(F.coalesce(good, F.lit(False))).alias("contributing_attempt_count"), F.avg(F.when(good, at)).alias(value)
    )
    some = F.col("contributing_attempt_count") > 0
    return out.select(
        *keys, F.lit("aggregate").alias("scope"), "contributing_attempt_count", value,
        F.when(some, "COMPUTED").otherwise("NOT_ESTIMABLE").alias("status"),
        F.when(~some, "No estimable attempts").alias("insufficiency_reason"),
    )


def complete_attempts(rows: DataFrame, status: str, category: str, expected: Sequence[str], attempt: str = "attempt_id") -> DataFrame:
    """Attempts that have a computed row for every expected category."""
    got = F.collect_set(F.when(F.col(status) == "COMPUTED", F.col(category)))
    wanted = F.array(*[F.lit(e) for e in expected])
    return rows.groupBy(attempt).agg(got.alias("_got")).where(F.size(F.array_except(wanted, F.col("_got"))) == 0).select(attempt)


def support_counts(adf, var, granger, irf, coint, discovery, attempt: str = "attempt_id") -> DataFrame:
    """Number of attempts each estimator could use."""
    having = lambda df, cond: df.where(cond).select(attempt).distinct()
    share = lambda m: (F.col("metric") == m) & (F.col("status") == "COMPUTED")
    parts = {
        "stationarity": complete_attempts(adf, "status", "venue", ("coinbase", "kraken")),
        "var": having(var, "fit_status = 'COMPUTED'"),
        "granger": complete_attempts(granger, "model_validity_status", "direction", DIRECTIONS),
        "irf": having(irf, "model_status = 'COMPUTED'"),
        "cointegration": having(coint, "residual_status = 'COMPUTED'"),
        "vecm": having(coint, "vecm_status = 'ESTIMABLE'"),
        "gonzalo_granger": having(discovery, share(GG)),
        "hasbrouck_is": having(discovery, share(HASBROUCK)),
    }
    out = None
    for name, rows in parts.items():
        line = rows.agg(F.count(F.lit(1)).alias("attempts")).select(F.lit(name).alias("estimator"), "attempts")
        out = line if out is None else out.unionAll(line)
    return out


def session_date(attempt: Column) -> Column:
    """First YYYY-MM-DD run of dash-separated tokens with a month 1-12 and a day 1-31; else null."""
    tokens = F.split(attempt, "-")
    starts = F.when(F.size(tokens) > 2, F.sequence(F.lit(1), F.size(tokens) - 2)).otherwise(F.array().cast("array<int>"))
    dates = F.transform(starts, lambda i: F.concat_ws("-", F.slice(tokens, i, F.lit(3))))
    good = lambda d: d.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
    return F.get(F.filter(dates, good), F.lit(0))


def attempt_summary(coint, var, granger, discovery, regressions, attempt: str = "attempt_id") -> DataFrame:
    """One row per attempt over all result tables; what is absent reads MISSING."""
    status = lambda c: F.coalesce(c, F.lit("MISSING"))
    of = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    tests = granger.groupBy(attempt).agg(
        *[
            of(d, c).alias(f"{short}_granger_{name}")
            for d, short in zip(DIRECTIONS, ("cb_kr", "kr_cb"))
            for c, name in (("test_statistic", "stat"), ("raw_p_value", "raw_p"), ("adjusted_p_value", "adj_p"), ("decision", "decision"))
        ]
    )
    preds = regressions.groupBy(attempt).agg(
        *[
            of(d, c).alias(f"{short}_{name}")
            for d, short in zip(DIRECTIONS, ("cb_pred_kr", "kr_pred_cb"))
            for c, name in (("coefficient", "coeff"), ("raw_p_value", "p"), ("fit_status", "status"))
        ]
    )
    part = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    shares = discovery.groupBy(attempt).agg(
        part(GG, "coinbase_value").alias("gg_coinbase_share"), part(GG, "kraken_value").alias("gg_kraken_share"),
        part(GG, "status").alias("gg_status"),
        part(HASBROUCK, "coinbase_lower").alias("hasbrouck_cb_lower"), part(HASBROUCK, "coinbase_upper").alias("hasbrouck_cb_upper"),
        part(HASBROUCK, "kraken_lower").alias("hasbrouck_kr_lower"), part(HASBROUCK, "kraken_upper").alias("hasbrouck_kr_upper"),
        part(HASBROUCK, "status").alias("hasbrouck_status"),
    )
    models = var.select(
        attempt, F.col("selected_lag").alias("var_selected_lag"),
        F.when(F.col("fit_status") != "COMPUTED", F.col("fit_status")).when(F.col("is_stable"), "STABLE")
        .otherwise("UNSTABLE").alias("var_status"),
    )
    base = coint.select(
        attempt, session_date(F.col(attempt)).alias("session_date"),
        F.col("inferred_cointegration_rank").alias("cointegration_rank"), F.col("vecm_status").alias("cointegration_status"),
    )
    joined = base
    for other in (models, tests, shares, preds):
        joined = joined.join(other, attempt, "left")
    labels = ["var_status", "cb_kr_granger_decision", "kr_cb_granger_decision", "gg_status", "hasbrouck_status",
              "cb_pred_kr_status", "kr_pred_cb_status"]
    return joined.withColumns({c: status(F.col(c)) for c in labels})


def summary_faults(summary: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Rows that must not exist: duplicate attempts, or computed results that are not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    faults = F.filter(
        F.array(
            F.when((F.col("var_status") == "STABLE") & (F.col("cb_kr_granger_decision") != "MISSING") & bad("cb_kr_granger_stat"), "cb_kr_granger"),
            F.when((F.col("var_status") == "STABLE") & (F.col("kr_cb_granger_decision") != "MISSING") & bad("kr_cb_granger_stat"), "kr_cb_granger"),
            F.when((F.col("gg_status") == "COMPUTED") & (bad("gg_coinbase_share") | bad("gg_kraken_share")), "component_share"),
            F.when((F.col("hasbrouck_status") == "COMPUTED") & (bad("hasbrouck_cb_lower") | bad("hasbrouck_kr_upper")), "information_bounds"),
            F.when((F.col("cb_pred_kr_status") == "COMPUTED") & (bad("cb_pred_kr_coeff") | bad("cb_pred_kr_p")), "cb_pred_kr"),
            F.when((F.col("kr_pred_cb_status") == "COMPUTED") & (bad("kr_pred_cb_coeff") | bad("kr_pred_cb_p")), "kr_pred_cb"),
        ),
        lambda x: x.isNotNull(),
    )
    repeated = summary.groupBy(attempt).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        attempt, F.array(F.lit("duplicate_attempt")).alias("faults")
    )
    return summary.select(attempt, faults.alias("faults")).where(F.size("faults") > 0).unionAll(repeated)


def figure_tables(summary: DataFrame, irf: DataFrame, robustness: DataFrame, attempt: str = "attempt_id") -> dict[str, DataFrame]:
    """Tidy data behind the four figures."""
    strength = lambda c: -F.log10(F.greatest(F.col(c), F.lit(1e-300)))
    return {
        "causality_strength": summary.select(
            attempt,
            F.inline(F.array(*[
                F.struct(F.lit(d).alias("direction"), strength(f"{s}_granger_adj_p").alias("minus_log10_adjusted_p"))
                for d, s in zip(DIRECTIONS, ("cb_kr", "kr_cb"))
            ])),
        ),
        "cumulative_response": irf.select(attempt, "ordering", "horizon", "cumulative_response"),
        "venue_shares": summary.select(
            attempt, "gg_coinbase_share", "gg_kraken_share", "hasbrouck_cb_lower", "hasbrouck_cb_upper",
            "hasbrouck_kr_lower", "hasbrouck_kr_upper",
        ),
        "stability_by_configuration": robustness.select("configuration_id", attempt, "status", "value"),
    }
