"""Which venue moves first: lagged return correlations, first movers and directional responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.operators.ordered import carry, haloed, sliced
from tandemtape.operators.sync import CELLS, SyncConfig

LAGS_MS = (-500, -250, -100, 0, 100, 250, 500)
ENOUGH_ROWS = 10


def lattice_returns(grid: DataFrame, config: SyncConfig, reach: int = 0, attempt: str = "attempt_id"):
    """h-step log returns valid only when both ends are accepted, on slices that see ``reach`` steps ahead."""
    h = config.horizon_ms // config.sampling_ms
    halo, track = haloed(grid, [attempt], "cell", back=h + reach, ahead=reach, size=CELLS)
    w = track.window()
    ok = ~F.col("is_rejected")
    change = lambda c: F.ln(c) - F.lag(F.ln(c), h).over(w)
    return (
        halo.withColumn("return_ok", F.coalesce(ok & F.lag(ok, h).over(w), F.lit(False)))
        .withColumn("cb_return", change("cb_mid"))
        .withColumn("kr_return", change("kr_mid")),
        track,
    )


def lag_pairs(lag: int, steps: int, w, as_published: bool) -> tuple[Column, Column, Column]:
    """Return pair of one lag: (venue 1, venue 2, both valid).  A positive lag means venue 2 leads.

    A negative lag pairs venue 1 now with venue 2 later.  ``as_published`` pairs it with venue 2 earlier, as the
    published tables do, where negative lags repeat the positive ones.
    """
    cb, kr, ok = F.col("cb_return"), F.col("kr_return"), F.col("return_ok")
    if steps == 0:
        return cb, kr, ok
    later = lambda c: F.lead(c, steps).over(w)
    earlier = lambda c: F.lag(c, steps).over(w)
    if lag > 0:
        return later(cb), kr, ok & later(ok)
    if as_published:
        return cb, earlier(kr), ok & earlier(ok)
    return cb, later(kr), ok & later(ok)


def guarded_correlation(x: Column, y: Column, valid: Column) -> tuple[Column, Column]:
    """Pearson correlation over complete valid pairs; null unless n > 2 and both deviations are positive."""
    use = valid & x.isNotNull() & y.isNotNull()
    a, b = F.when(use, x), F.when(use, y)
    n = F.count(a)
    return F.when((n > 2) & (F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0), F.corr(a, b)), n


def lead_lag(
    grid: DataFrame, config: SyncConfig, lags_ms: Sequence[int] = LAGS_MS, as_published: bool = False,
    attempt: str = "attempt_id",
) -> DataFrame:
    """Correlation by lag.  Steps truncate toward zero, so ±250 on a 100 grid is two steps."""
    steps = {lag: abs(lag) // config.sampling_ms for lag in lags_ms}
    far = max(steps.values())
    rows, track = lattice_returns(grid, config, far, attempt)
    w = track.window()
    for i, lag in enumerate(lags_ms):
        x, y, ok = lag_pairs(lag, steps[lag], w, as_published)
        rows = rows.withColumns({f"_x{i}": x, f"_y{i}": y, f"_ok{i}": F.coalesce(ok, F.lit(False))})
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i in range(len(lags_ms)):
        value, n = guarded_correlation(F.col(f"_x{i}"), F.col(f"_y{i}"), F.col(f"_ok{i}"))
        aggregates += [value.alias(f"_c{i}"), n.alias(f"_n{i}")]
    wide = rows.where("_own").groupBy(attempt).agg(*aggregates).where(F.col("_rows") > ENOUGH_ROWS)
    long = F.array(
        *[
            F.struct(
                F.lit(lag).cast("bigint").alias("lag"),
                F.lit(
                    "kraken_leads_coinbase" if lag > 0 else "coinbase_leads_kraken" if lag < 0 else "contemporaneous"
                ).alias("direction"),
                F.col(f"_c{i}").alias("correlation"), F.col(f"_n{i}").alias("effective_sample_count"),
            )
            for i, lag in enumerate(lags_ms)
        ]
    )
    return wide.select(attempt, F.explode(long).alias("r")).select(
        attempt,
        F.lit(config.sampling_ms).cast("bigint").alias("sampling_interval_ms"),
        F.lit(config.horizon_ms).cast("bigint").alias("return_horizon_ms"),
        "r.*",
        F.when(F.col("r.correlation").isNotNull(), "COMPUTED").otherwise("INSUFFICIENT_SAMPLE").alias("status"),
    )


def moves(grid: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Price changes between neighbouring accepted points (gaps are bridged) and the change that follows each."""
    accepted = grid.where(~F.col("is_rejected")).select(attempt, "cell", "cb_mid", "kr_mid")
    placed, track = sliced(accepted, [attempt], ["cell"], "cell", CELLS)
    mids = F.struct("cb_mid", "kr_mid")
    near = carry(placed, track, before={"_p": mids}, after={"_n": mids})
    return near.select(
        attempt, "cell",
        (F.col("cb_mid") - F.col("_p.cb_mid")).alias("cb_move"), (F.col("kr_mid") - F.col("_p.kr_mid")).alias("kr_move"),
        (F.col("_n.cb_mid") - F.col("cb_mid")).alias("cb_next"), (F.col("_n.kr_mid") - F.col("kr_mid")).alias("kr_next"),
    )


def leaders(grid: DataFrame, config: SyncConfig, attempt: str = "attempt_id") -> DataFrame:
    """First movers, simultaneous moves, and how often the other venue follows in the same direction next."""
    cb, kr = F.col("cb_move"), F.col("kr_move")
    cb_next, kr_next = F.col("cb_next"), F.col("kr_next")
    counts = moves(grid, attempt).groupBy(attempt).agg(
        F.count_if((cb != 0) & (kr == 0)).alias("coinbase_first_count"),
        F.count_if((kr != 0) & (cb == 0)).alias("kraken_first_count"),
        F.count_if((cb != 0) & (kr != 0)).alias("simultaneous_count"),
        F.count_if((cb != 0) & (kr == 0) & (cb * kr_next > 0)).alias("_cb_followed"),
        F.count_if((kr != 0) & (cb == 0) & (kr * cb_next > 0)).alias("_kr_followed"),
        F.count(F.lit(1)).alias("effective_sample_count"),
    ).where(F.col("effective_sample_count") > ENOUGH_ROWS)
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))
    return counts.select(
        attempt, "coinbase_first_count", "kraken_first_count", "simultaneous_count",
        F.lit(0).cast("bigint").alias("unresolved_count"),
        share("_cb_followed", "coinbase_first_count").alias("coinbase_first_directional_response"),
        share("_kr_followed", "kraken_first_count").alias("kraken_first_directional_response"),
        F.lit(config.sampling_ms).cast("bigint").alias("response_horizon_ms"), "effective_sample_count",
    )
