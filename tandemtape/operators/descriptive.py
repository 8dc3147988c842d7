"""Descriptive statistics of trades and quotes per attempt and venue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators.ordered import carry, sliced
from tandemtape.operators.scans import scan
from tandemtape.session import cut

MEDIAN = ("linear", 0.5)
P25, P50, P75, P95 = (("nearest", q) for q in (0.25, 0.5, 0.75, 0.95))


def describe(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Count, mean, median, sample deviation, extremes and quartiles of the non-null values."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias(f"{prefix}count"), F.avg(value).alias(f"{prefix}mean"),
        F.stddev_samp(value).alias(f"{prefix}std"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"),
    )
    ranks = exact_quantiles(
        df, keys, value, {f"{prefix}median": MEDIAN, f"{prefix}p25": P25, f"{prefix}p75": P75}
    ).drop("n")
    return moments.join(ranks, list(keys), "left")


def describe_spread(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """``describe`` plus sign counts and the number of values beyond the threshold."""
    at = F.col(value)
    signs = df.groupBy(*keys).agg(
        F.count_if(at > 0).alias("positive_count"), F.count_if(at < 0).alias("negative_count"),
        F.count_if(at == 0).alias("zero_count"), F.count_if(F.abs(at) > threshold).alias("breach_count"),
    )
    return describe(df, keys, value).join(signs, list(keys))


def steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, prior: Mapping[str, Column]) -> DataFrame:
    """Values of the row before, in record order."""
    placed, track = sliced(df, keys, order, position)
    return carry(placed, track, before=prior)


def log_returns(trades: DataFrame, keys: Sequence[str], order: Sequence[str] = ("record_index",), price: str = "price") -> DataFrame:
    """Log return against the previous row with a price, in record order (not time order)."""
    priced = F.col(price).isNotNull()
    placed, track = sliced(trades, keys, order, order[0])
    before = carry(placed, track, before={"_p": (F.ln(price), priced)})
    return before.withColumn("log_return", F.ln(price) - F.col("_p")).drop("_p", "_slice")


def interarrival(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("record_index",), ts: str = "ts_us"
) -> DataFrame:
    """Milliseconds since the previous row that has a time, in record order."""
    timed = rows.where(F.col(ts).isNotNull())
    placed, track = sliced(timed, keys, order, order[0])
    return carry(placed, track, before={"_t": F.col(ts)}).withColumn(
        "interarrival_ms", (F.col(ts) - F.col("_t")) / 1000.0
    ).drop("_t", "_slice")


def sorted_interarrival_median(rows: DataFrame, keys: Sequence[str], ts: str = "ts_us") -> DataFrame:
    """Median gap in time order.  Equal times collapse to one row with a weight before any ordering happens."""
    instants = cut(rows.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n")))
    gaps = scan(instants, keys, [ts], before={"_t": F.col(ts)})
    pairs = gaps.select(
        *keys,
        F.explode(
            F.array(
                F.struct(((F.col(ts) - F.col("_t")) / 1000.0).alias("gap_ms"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(0.0).alias("gap_ms"), (F.col("_n") - 1).alias("w")),
            )
        ).alias("g"),
    ).select(*keys, "g.*").where("w > 0")
    return exact_quantiles(pairs, keys, "gap_ms", {"median_interarrival_ms": MEDIAN}, weight="w").withColumnRenamed(
        "n", "interarrival_count"
    )


def attempt_statistics(
    trades: DataFrame, quotes: DataFrame, bounds: DataFrame, trim_ms: int, attempt: str = "attempt_id"
) -> DataFrame:
    """One wide row per attempt and venue over price, return, size, inter-arrival and intensity."""
    keys = [attempt, "venue"]
    placed, track = sliced(trades.select(*keys, "record_index", "ts_us", "price", "quantity"), keys, ["record_index"], "record_index")
    linked = carry(
        placed, track,
        before={"_p": (F.ln("price"), F.col("price").isNotNull()), "_t": (F.col("ts_us"), F.col("ts_us").isNotNull())},
    )
    moved = cut(linked.select(
        *keys, "ts_us", "price", "quantity", (F.ln("price") - F.col("_p")).alias("log_return"),
        ((F.col("ts_us") - F.col("_t")) / 1000.0).alias("interarrival_ms"),
    ))
    quoted = cut(interarrival(quotes.select(*keys, "record_index", "ts_us"), keys))
    r = F.col("log_return")
    span = lambda: (F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)
    rate = lambda: F.when(span() > 0, F.count("ts_us") / span()).otherwise(F.lit(0.0))
    base = moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.count("price").alias("trade_price_count"), F.avg("price").alias("trade_price_mean"),
        F.stddev_samp("price").alias("trade_price_std"), F.min("price").alias("trade_price_min"),
        F.max("price").alias("trade_price_max"),
        F.count(r).alias("log_return_count"), F.avg(r).alias("log_return_mean"), F.stddev_samp(r).alias("log_return_std"),
        F.avg(F.abs(r)).alias("absolute_return_mean"),
        F.sqrt(F.coalesce(F.sum(r * r), F.lit(0.0))).alias("realized_volatility"),
        F.count("quantity").alias("trade_size_count"), F.avg("quantity").alias("trade_size_mean"),
        F.stddev_samp("quantity").alias("trade_size_std"),
        F.count("interarrival_ms").alias("trade_interarrival_count"),
        F.avg("interarrival_ms").alias("trade_interarrival_mean_ms"),
        rate().alias("trade_intensity_per_second"),
    )
    of_quotes = quoted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("quote_count"),
        F.count("interarrival_ms").alias("quote_interarrival_count"),
        F.avg("interarrival_ms").alias("quote_interarrival_mean_ms"),
        rate().alias("quote_intensity_per_second"),
    )
    # All rank statistics in one long table, so the quantile passes run once.
    wanted = {
        "price": ("trade_price", {"median": MEDIAN, "p25": P25, "p75": P75, "p95": P95}),
        "log_return": ("log_return", {"p25": P25, "p50": P50, "p75": P75}),
        "abs_return": ("absolute_return", {"median": MEDIAN, "p75": P75, "p95": P95}),
        "quantity": ("trade_size", {"median": MEDIAN, "p25": P25, "p75": P75, "p95": P95}),
        "interarrival_ms": ("trade_interarrival", {"median": MEDIAN, "p95": P95}),
    }
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    long = moved.withColumn("abs_return", F.abs(r)).select(
        *keys, F.explode(F.array(*[pair(m, F.col(m)) for m in wanted])).alias("m")
    ).unionByName(quoted.select(*keys, pair("quote_interarrival", F.col("interarrival_ms")).alias("m")))
    picks = {"median": MEDIAN, "p25": P25, "p50": P50, "p75": P75, "p95": P95}
    ranks = exact_quantiles(long.select(*keys, "m.metric", "m.value"), [*keys, "metric"], "value", picks)
    suffix = lambda m, stat: f"_{stat}_ms" if "interarrival" in m else f"_{stat}"
    wanted["quote_interarrival"] = ("quote_interarrival", {"median": MEDIAN, "p95": P95})
    spread = ranks.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(stat))).alias(prefix + suffix(m, stat))
            for m, (prefix, stats) in wanted.items()
            for stat in stats
        ]
    )
    start, end = F.col("start_us"), F.col("end_us")
    usable = end - start - 2 * trim_ms * 1000
    spans = bounds.select(
        attempt, start.alias("empirical_overlap_start_us"), end.alias("empirical_overlap_end_us"),
        F.coalesce((end - start) / F.lit(1e6), F.lit(0.0)).alias("untrimmed_overlap_seconds"),
        (start + trim_ms * 1000).alias("trimmed_start_us"), (end - trim_ms * 1000).alias("trimmed_end_us"),
        F.when(usable > 0, usable / F.lit(1e6)).otherwise(F.lit(0.0)).alias("trimmed_usable_seconds"),
    )
    return (
        base.join(of_quotes, keys, "full").join(spread, keys, "left").join(spans, attempt, "left")
        .withColumn("realized_volatility_definition", F.lit("sqrt(sum(log_return^2))"))
    )
