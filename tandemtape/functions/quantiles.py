"""Exact quantiles of groups of any size.

``percentile`` and ``collect_list`` keep a whole group in one task.  Here a group is first collapsed to
(value, weight) pairs by a map-side combined aggregate, then located through two levels of order-preserving
buckets, so no task ever sorts more than one bucket of one group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets are logarithmic: FINE per e-fold, grouped COARSE fine buckets at a time.
FINE = 1 << 20
COARSE = 1 << 12
SHIFT = 800 * FINE


def bucket(value: Column) -> Column:
    """Non-decreasing long bucket of a double (natural log is semi-monotonic in the JVM)."""
    magnitude = F.floor(F.ln(F.abs(value)) * FINE) + SHIFT
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude).cast("long")


def rank_bounds(rule: str, q: float, n: Column) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank and weight of the upper one for ``n`` values.

    linear: interpolate; nearest: half away from zero; round_even: banker's rounding; ceil: next index up.
    """
    at = (n - 1) * F.lit(float(q))
    if rule == "linear":
        low = F.floor(at)
        return low.cast("long"), F.ceil(at).cast("long"), at - low
    picked = {"nearest": F.round(at), "round_even": F.bround(at), "ceil": F.ceil(at)}[rule].cast("long")
    return picked, picked, F.lit(0.0)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: Mapping[str, tuple[str, float]],
    weight: str | None = None,
) -> DataFrame:
    """One row per key with ``n`` and one column per pick ``name -> (rule, q)``; nulls are ignored."""
    keys = list(keys)
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(amount).alias("_w"))
        .withColumn("_fine", bucket(F.col("_v")))
        .withColumn("_coarse", F.floor(F.col("_fine") / COARSE))
    )
    sizes = values.groupBy(*keys, "_coarse").agg(F.sum("_w").alias("_w"))
    up_to = Window.partitionBy(*keys).orderBy("_coarse")
    whole = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_end", F.sum("_w").over(up_to)).withColumn("n", F.sum("_w").over(whole))
    wanted = []
    for name, (rule, q) in picks.items():
        low, high, share = rank_bounds(rule, q, F.col("n"))
        for rank, part in ((low, 1.0 - share), (high, share)):
            wanted.append(F.struct(F.lit(name).alias("pick"), rank.alias("rank"), part.cast("double").alias("part")))
    inside = lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_w"))
    targets = sizes.select(
        *keys, "_coarse", "n", (F.col("_end") - F.col("_w")).alias("_before"),
        F.explode(F.filter(F.array(*wanted), inside)).alias("_t"),
    )
    narrowed = _narrow(
        values.groupBy(*keys, "_coarse", "_fine").agg(F.sum("_w").alias("_w")), targets, keys, "_coarse", "_fine"
    )
    found = _narrow(values.select(*keys, "_fine", "_v", "_w"), narrowed, keys, "_fine", "_v")
    out = found.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.sum(F.when(F.col("_t.pick") == name, F.col("_v") * F.col("_t.part"))).alias(name) for name in picks],
    )
    return out


def _narrow(rows: DataFrame, targets: DataFrame, keys: Sequence[str], outer: str, inner: str) -> DataFrame:
    """Rows of the wanted ``outer`` buckets whose running weight covers a wanted rank."""
    reach = targets.groupBy(*keys, outer).agg(
        F.first("n").alias("n"), F.first("_before").alias("_before"), F.collect_list("_t").alias("_ts")
    )
    ordered = Window.partitionBy(*keys, outer).orderBy(inner)
    hit = lambda t: (t["rank"] < F.col("_end")) & (t["rank"] >= F.col("_end") - F.col("_w"))
    return (
        rows.join(reach, [*keys, outer])
        .withColumn("_end", F.col("_before") + F.sum("_w").over(ordered))
        .select(
            *keys, inner, "n", (F.col("_end") - F.col("_w")).alias("_before"),
            F.explode(F.filter("_ts", hit)).alias("_t"),
        )
    )
