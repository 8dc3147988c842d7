"""Quotes of two venues on a fixed time lattice, with staleness rules and spread measures.

The as-of join is done per lattice cell.  Quotes are first reduced to the last one per (attempt, cell, venue) by a
map-side combined aggregate, so however dense or skewed the feed is, at most one quote per cell and venue is shuffled
further.  The lattice is then filled forward in slices of a bounded number of cells.  All sampling steps and trims that
are multiples of the finest step share this one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators.ordered import Track, carry
from tandemtape.schemas import VENUE_1, VENUE_2
from tandemtape.session import cut

CELLS = 1 << 16


@dataclass(frozen=True)
class SyncConfig:
    """One synchronization design; times in milliseconds."""

    name: str = "baseline"
    sampling_ms: int = 100
    tolerance_ms: int = 50
    stale_ms: int = 2000
    trim_ms: int = 300_000
    enforce_tolerance: bool = False
    horizon_ms: int = 100
    spread_threshold_bps: float = 5.0


def designs(base: SyncConfig, unit: int = 1) -> list[SyncConfig]:
    """The nine robustness designs around a baseline; ``unit`` stretches the fixed variants to slower clocks."""
    return [
        replace(base, name="baseline"),
        replace(base, name="strict_freshness_50ms", enforce_tolerance=True),
        replace(base, name="tighter_alignment", tolerance_ms=10 * unit, enforce_tolerance=True),
        replace(base, name="looser_alignment", tolerance_ms=500 * unit, enforce_tolerance=True),
        replace(base, name="tighter_stale", stale_ms=100 * unit),
        replace(base, name="looser_stale", stale_ms=10_000 * unit),
        replace(base, name="faster_sampling", sampling_ms=50 * unit),
        replace(base, name="slower_sampling", sampling_ms=1000 * unit),
        replace(base, name="no_trim", trim_ms=0),
    ]


def finest_step(configs: Sequence[SyncConfig]) -> int:
    """Largest step that every sampling interval and trim is a multiple of."""
    return reduce(gcd, [c.sampling_ms for c in configs] + [c.trim_ms for c in configs if c.trim_ms])


def overlap(rows: DataFrame, attempt: str = "attempt_id", venue: str = "venue", ts: str = "ts_us") -> DataFrame:
    """Shared time span of both venues per attempt: latest start, earliest end, seconds (0 and nulls when empty)."""
    side = lambda v, agg: agg(F.when(F.col(venue) == v, F.col(ts)))
    spans = rows.where(F.col(ts).isNotNull()).groupBy(attempt).agg(
        side(VENUE_1, F.min).alias("_s1"), side(VENUE_2, F.min).alias("_s2"),
        side(VENUE_1, F.max).alias("_e1"), side(VENUE_2, F.max).alias("_e2"),
    )
    both = F.col("_s1").isNotNull() & F.col("_s2").isNotNull()
    start, end = F.greatest("_s1", "_s2"), F.least("_e1", "_e2")
    shared = both & (end > start)
    return spans.select(
        attempt,
        F.when(shared, start).alias("start_us"), F.when(shared, end).alias("end_us"),
        F.when(shared, (end - start) / F.lit(1e6)).otherwise(F.lit(0.0)).alias("overlap_seconds"),
    )


def trimmed(bounds: DataFrame, trim_ms: int) -> DataFrame:
    """Bounds with both ends cut; spans that vanish are dropped."""
    return bounds.select(
        *[c for c in bounds.columns if c not in ("start_us", "end_us")],
        (F.col("start_us") + trim_ms * 1000).alias("start_us"), (F.col("end_us") - trim_ms * 1000).alias("end_us"),
    ).where("end_us > start_us")


def lattice(bounds: DataFrame, step_ms: int, attempt: str = "attempt_id") -> DataFrame:
    """Lattice cells of each attempt, both ends inclusive.

    Slices are laid out first and spread over tasks, then each slice lists its own cells, so one long attempt neither
    builds one long array nor runs in one task.
    """
    step = step_ms * 1000
    whole = bounds.where(F.col("start_us").isNotNull()).withColumn(
        "_last", F.floor((F.col("end_us") - F.col("start_us")) / step)
    )
    slices = whole.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / CELLS)))
    ).repartition(attempt, "_slice")
    first = F.col("_slice") * CELLS
    cells = slices.withColumn("cell", F.explode(F.sequence(first, F.least(F.col("_last"), first + CELLS - 1))))
    return cells.select(
        attempt, "_slice", "cell", "start_us", "end_us", (F.col("start_us") + F.col("cell") * step).alias("anchor_us")
    )


def last_per_cell(
    quotes: DataFrame, bounds: DataFrame, step_ms: int, attempt: str = "attempt_id", tie: str = "record_index"
) -> DataFrame:
    """Latest quote of each venue in every cell it reaches; quotes before the start count for cell 0."""
    step = step_ms * 1000
    placed = quotes.where(F.col("ts_us").isNotNull()).join(bounds.where("start_us IS NOT NULL"), attempt)
    cell = F.greatest(F.ceil((F.col("ts_us") - F.col("start_us")) / step), F.lit(0))
    placed = placed.withColumn("cell", cell).where(F.col("ts_us") <= F.col("end_us"))
    quote = F.struct(F.col("ts_us"), F.col(tie), ((F.col("bid_price") + F.col("ask_price")) / 2.0).alias("mid"))
    of = lambda v: F.max(F.when(F.col("venue") == v, quote))
    return placed.groupBy(attempt, "cell").agg(of(VENUE_1).alias("_q1"), of(VENUE_2).alias("_q2"))


def as_of(
    quotes: DataFrame, bounds: DataFrame, step_ms: int, attempt: str = "attempt_id", tie: str = "record_index"
) -> DataFrame:
    """Backward as-of join of both venues onto the lattice; no tolerance is applied here.

    The bounds, the reduced quotes and the finished lattice are cut: each is read more than once.
    """
    bounds = cut(bounds)
    cells = lattice(bounds, step_ms, attempt)
    last = cut(last_per_cell(quotes, bounds, step_ms, attempt, tie))
    kind = last.schema["_q1"].dataType
    both = cells.select(
        attempt, "_slice", "cell", F.lit(True).alias("_grid"), "anchor_us", "start_us", "end_us",
        F.lit(None).cast(kind).alias("_q1"), F.lit(None).cast(kind).alias("_q2"),
    ).unionByName(
        last.select(
            attempt, F.floor(F.col("cell") / CELLS).alias("_slice"), "cell", F.lit(False).alias("_grid"),
            F.lit(None).cast("bigint").alias("anchor_us"), F.lit(None).cast("bigint").alias("start_us"),
            F.lit(None).cast("bigint").alias("end_us"), "_q1", "_q2",
        )
    )
    filled = carry(
        both, Track((attempt,), ("cell", "_grid")),
        upto={
            "q1": (F.col("_q1"), F.col("_q1").isNotNull()), "q2": (F.col("_q2"), F.col("_q2").isNotNull()),
        },
    ).where("_grid")
    return cut(filled.select(
        attempt, "cell", "anchor_us", "start_us", "end_us",
        F.col("q1.ts_us").alias("cb_ts_us"), F.col("q1.mid").alias("cb_mid"),
        F.col("q2.ts_us").alias("kr_ts_us"), F.col("q2.mid").alias("kr_mid"),
    ))


def measures(grid: DataFrame) -> DataFrame:
    """Quote ages in ms and spreads of venue 1 over venue 2."""
    gap = F.col("cb_mid") - F.col("kr_mid")
    bps = gap / F.col("kr_mid") * 10000
    return grid.withColumns(
        {
            "cb_age_ms": (F.col("anchor_us") - F.col("cb_ts_us")) / 1000.0,
            "kr_age_ms": (F.col("anchor_us") - F.col("kr_ts_us")) / 1000.0,
            "signed_spread": gap,
            "absolute_spread": F.abs(gap),
            "signed_spread_bps": bps,
            "absolute_spread_bps": F.abs(bps),
        }
    )


def rejection(config: SyncConfig) -> Column:
    """Why a grid point is refused.  A missing quote has a null age, passes every test and keeps a null mid."""
    cb, kr = F.col("cb_age_ms"), F.col("kr_age_ms")
    return (
        F.when(cb > config.stale_ms, "COINBASE_STALE")
        .when(kr > config.stale_ms, "KRAKEN_STALE")
        .when(
            F.lit(config.enforce_tolerance) & ((cb > config.tolerance_ms) | (kr > config.tolerance_ms)),
            "ALIGNMENT_TOLERANCE_EXCEEDED",
        )
        .otherwise("none")
    )


def judged(grid: DataFrame, config: SyncConfig) -> DataFrame:
    """Grid with ages, spreads, rejection reason and flags under one design."""
    stale = (F.col("cb_age_ms") > config.stale_ms) | (F.col("kr_age_ms") > config.stale_ms)
    return (
        measures(grid)
        .withColumn("rejection_reason", rejection(config))
        .withColumn("is_stale", stale)
        .withColumn("is_rejected", F.col("rejection_reason") != "none")
    )


def member(config: SyncConfig, step_ms: int) -> Column:
    """Whether a cell of the untrimmed finest lattice is an anchor of the design."""
    trim, every = config.trim_ms // step_ms, config.sampling_ms // step_ms
    end = F.col("end_us") - config.trim_ms * 1000
    start = F.col("start_us") + config.trim_ms * 1000
    return (
        (F.col("cell") >= trim) & ((F.col("cell") - trim) % every == 0) & (F.col("anchor_us") <= end) & (end > start)
    )


def synchronize(quotes: DataFrame, bounds: DataFrame, config: SyncConfig, attempt: str = "attempt_id") -> DataFrame:
    """One design end to end: trimmed lattice, as-of, measures, rejection."""
    return judged(as_of(quotes, trimmed(bounds, config.trim_ms), config.sampling_ms, attempt), config)


def spread_rows(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and moments of the accepted spreads in one aggregate; medians come from the quantile operator."""
    ok = ~F.col("is_rejected")
    kept = lambda c: F.when(ok, F.col(c))
    return grid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(ok).alias("accepted_count"),
        F.count_if(F.col("is_rejected")).alias("rejected_count"),
        F.count_if("is_stale").alias("stale_count"),
        F.count_if(ok & F.col("cb_mid").isNull() | ok & F.col("kr_mid").isNull()).alias("no_quote_count"),
        F.avg(kept("signed_spread")).alias("mean_signed_spread"),
        F.stddev_samp(kept("signed_spread")).alias("std_signed_spread"),
        F.min(kept("signed_spread")).alias("minimum_signed_spread"),
        F.max(kept("signed_spread")).alias("maximum_signed_spread"),
        F.avg(kept("absolute_spread")).alias("mean_absolute_spread"),
        F.avg(kept("signed_spread_bps")).alias("mean_signed_spread_bps"),
        F.avg(kept("absolute_spread_bps")).alias("mean_absolute_spread_bps"),
        F.count_if(ok & (F.col("signed_spread") > 0)).alias("positive_frequency"),
        F.count_if(ok & (F.col("signed_spread") < 0)).alias("negative_frequency"),
        F.count_if(ok & (F.col("signed_spread") == 0)).alias("zero_frequency"),
    )


def breach_count(column: str, threshold: float) -> Column:
    return F.count_if(~F.col("is_rejected") & (F.abs(column) > threshold))


def spread_statistics(grid: DataFrame, config: SyncConfig, attempt: str = "attempt_id") -> DataFrame:
    """Spread table: one row per attempt and one true pool over all accepted points."""
    sets = grid.withColumn("_all", F.lit("ALL"))
    each = spread_rows(sets, [attempt])
    pool = spread_rows(sets, ["_all"]).withColumnRenamed("_all", attempt)
    accepted = sets.where(~F.col("is_rejected"))
    pick = {"median_signed_spread": ("linear", 0.5)}
    middle = exact_quantiles(accepted, [attempt], "signed_spread", pick).unionByName(
        exact_quantiles(accepted, ["_all"], "signed_spread", pick).withColumnRenamed("_all", attempt)
    )
    attempts = each.select(F.count(F.lit(1))).scalar()
    labelled = each.withColumns({"scope": F.lit("per_attempt"), "result_label": F.lit("canonical")}).unionByName(
        pool.withColumns({"scope": F.lit("pooled"), "result_label": F.lit("EXPLORATORY")})
    )
    return (
        labelled.join(middle.select(attempt, "median_signed_spread"), attempt, "left")
        .withColumn("configuration_id", F.lit(config.name))
        .withColumn("contributing_attempt_count", F.when(F.col("scope") == "pooled", attempts).otherwise(1))
    )


def robustness(
    quotes: DataFrame, bounds: DataFrame, configs: Sequence[SyncConfig], attempt: str = "attempt_id"
) -> DataFrame:
    """All designs from one as-of pass: per attempt and design, candidates, accepted and spread; plus the pool."""
    step = finest_step(configs)
    grid = measures(as_of(quotes, bounds, step, attempt))
    tests = []
    for c in configs:
        inside = member(c, step)
        accepted = inside & (rejection(c) == "none")
        tests.append(
            (
                F.count_if(inside).alias("candidate_count"),
                F.count_if(accepted).alias("accepted_count"),
                F.sum(F.when(accepted, F.col("signed_spread"))).alias("_sum"),
                F.count(F.when(accepted, F.col("signed_spread"))).alias("_n"),
            )
        )
    names = ("candidate_count", "accepted_count", "_sum", "_n")
    wide = grid.groupBy(attempt).agg(
        *[value.alias(f"{name}_{i}") for i, group in enumerate(tests) for name, value in zip(names, group)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("configuration_id"), F.lit(c.sampling_ms).cast("bigint").alias("sampling_interval_ms"),
                F.lit(c.tolerance_ms).cast("bigint").alias("alignment_tolerance_ms"),
                F.lit(c.stale_ms).cast("bigint").alias("stale_threshold_ms"),
                F.lit(c.trim_ms).cast("bigint").alias("trim_ms"),
                *[F.col(f"{n}_{i}").alias(n) for n in names],
            )
            for i, c in enumerate(configs)
        ]
    )
    long = wide.select(attempt, F.explode(rows).alias("r")).select(attempt, "r.*").where("candidate_count > 0")
    labels = ["configuration_id", "sampling_interval_ms", "alignment_tolerance_ms", "stale_threshold_ms", "trim_ms"]
    pooled = long.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("contributing_attempt_count"), *[F.sum(n).alias(n) for n in names]
    ).withColumns({attempt: F.lit("ALL"), "scope": F.lit("pooled")})
    each = long.withColumns({"contributing_attempt_count": F.lit(1).cast("bigint"), "scope": F.lit("per_attempt")})
    return each.unionByName(pooled).select(
        *labels, "scope", attempt, "candidate_count", "accepted_count", "contributing_attempt_count",
        (F.col("_sum") / F.nullif("_n", F.lit(0))).alias("spread_metric"),
    )
