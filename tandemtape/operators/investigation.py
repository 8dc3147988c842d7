"""Deeper looks at a session: deltas by channel, continuity, missing ids, stale intervals, policy comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators.ordered import haloed
from tandemtape.operators.scans import scan
from tandemtape.session import cut

def delta_statistics(events: DataFrame, keys: Sequence[str], value: str = "delta_ms", index: str = "record_index") -> DataFrame:
    """Count, negatives, extremes, next-index-up ranks, population deviation, first and last negative row."""
    v = F.col(value)
    base = events.groupBy(*keys).agg(
        F.count(v).alias("events"), F.count_if(v < 0).alias("negative_count"), F.min(v).alias("minimum_ms"),
        F.max(v).alias("maximum_ms"), F.stddev_pop(v).alias("standard_deviation_ms"),
        F.min(F.when(v < 0, F.col(index))).alias("first_negative_index"),
        F.max(F.when(v < 0, F.col(index))).alias("last_negative_index"),
    )
    ranks = exact_quantiles(
        events, keys, value,
        {"median_ms": ("linear", 0.5), "p95_ms": ("ceil", 0.95), "p99_ms": ("ceil", 0.99), "_p75": ("ceil", 0.75), "_p25": ("ceil", 0.25)},
    ).drop("n")
    out = base.join(ranks, list(keys), "left")
    return out.withColumn("iqr_ms", F.col("_p75") - F.col("_p25")).withColumn(
        "negative_share", F.when(F.col("events") > 0, F.col("negative_count") / F.col("events")).otherwise(0.0)
    ).drop("_p75", "_p25")


def delta_class(stats: DataFrame) -> DataFrame:
    """Pattern by deviation and share of negatives (other inputs and cut-offs than the calibrated pattern)."""
    n, share, dev = F.col("events"), F.col("negative_share"), F.col("standard_deviation_ms")
    return stats.withColumn(
        "classification",
        F.when(n < 10, "insufficient evidence").when((share > 0.8) & (dev < 1000), "stable offset")
        .when(dev < 250, "low-variance offset").when(share < 0.05, "sporadic outliers")
        .when(dev > 1000, "highly unstable").otherwise("mixed distribution"),
    )


def delta_by_channel(events: DataFrame, groups: Sequence[str] = ("channel", "message", "connection_epoch")) -> DataFrame:
    """Delta statistics per group and for all events together (grouping sets over one expanded table)."""
    all_rows = events.select(
        *[F.lit(None).cast(events.schema[g].dataType).alias(g) for g in groups], F.lit(True).alias("is_total"),
        "delta_ms", "record_index",
    )
    each = events.select(*groups, F.lit(False).alias("is_total"), "delta_ms", "record_index")
    # A null-safe surrogate keeps the total row's null keys through the joins inside.
    marked = each.unionAll(all_rows).withColumn("_g", F.to_json(F.struct(*groups, "is_total")))
    names = marked.groupBy("_g").agg(*[F.first(g).alias(g) for g in groups], F.first("is_total").alias("is_total"))
    return names.join(delta_class(delta_statistics(marked, ["_g"])), "_g").drop("_g")


def minute_windows(events: DataFrame, keys: Sequence[str] = (), ts: str = "receipt_ts") -> DataFrame:
    """Delta statistics per one-minute receipt window."""
    cut = events.withColumn("window_start", F.unix_micros(F.window(ts, "1 minute")["start"]))
    return delta_statistics(cut, [*keys, "window_start"])


def continuity_class(row: DataFrame) -> DataFrame:
    """First that holds: missing trades, sequence jumps, duplicates, reversals."""
    return row.withColumn(
        "classification",
        F.when(F.col("suspicious_intervals") > 0, "confirmed missing-match evidence")
        .when(F.col("jumps") > 0, "product-level sequence discontinuity").when(F.col("duplicates") > 0, "duplicate sequence")
        .when(F.col("reversals") > 0, "out-of-order sequence").otherwise("insufficient evidence"),
    )


def type_view(checks: DataFrame) -> DataFrame:
    """Wording per message type over its own sequence checks."""
    return checks.withColumn(
        "classification",
        F.when(F.col("jumps") > 0, "per-message-type diagnostic jump").when(F.col("observations") < 2, "insufficient evidence")
        .otherwise("no diagnostic jump"),
    )


def missing_spans(ids: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs of absent ids between neighbouring seen ones: [missing_from, missing_to].

    Spans replace the list of every id of a range, so the work follows the ids seen, not the width of the range.
    """
    seen = ids.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("id")).distinct()
    return scan(cut(seen), keys, ["id"], before={"_low": F.col("id")}).where(F.col("id") - F.col("_low") > 1).select(
        *keys, (F.col("_low") + 1).alias("missing_from"), (F.col("id") - 1).alias("missing_to"),
        (F.col("id") - F.col("_low") - 1).alias("missing_ids"),
    )


def surrounding_ids(ids: DataFrame, heard: DataFrame, keys: Sequence[str], value: str, last_id: str) -> DataFrame:
    """Per heartbeat: missing ids up to it and the nearest seen ids strictly below and above."""
    seen = ids.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("id")).distinct()
    beats = heard.where(F.col(last_id).isNotNull()).select(
        *keys, F.col(last_id).cast("bigint").alias("id"), F.col("record_index").alias("heartbeat_index")
    )
    # Equal heartbeat ids ask the same question, so it is answered once per id.
    asked = beats.select(*keys, "id").distinct()
    both = seen.withColumn("_s", F.lit(1)).unionAll(asked.withColumn("_s", F.lit(0))).groupBy(*keys, "id").agg(
        F.max("_s").alias("seen"), F.min("_s").alias("_a")
    ).withColumn("asked", F.col("_a") == 0)
    is_seen = F.col("seen") == 1
    around = scan(
        cut(both), keys, ["id"], before={"below": (F.col("id"), is_seen)}, after={"above": (F.col("id"), is_seen)},
        sums={"_count": F.col("seen").cast("bigint")},
    )
    first = seen.groupBy(*keys).agg(F.min("id").alias("_first"))
    answered = around.where("asked").join(first, list(keys), "left").select(
        *keys, "id", F.col("below").alias("previous_seen_id"), F.col("above").alias("next_seen_id"),
        F.when(F.coalesce("_first", F.col("id")) > F.col("id"), F.lit(0))
        .otherwise(F.col("id") - F.coalesce("_first", F.col("id")) + 1 - F.col("_count")).alias("missing_ids"),
    )
    return beats.join(answered, [*keys, "id"]).withColumnRenamed("id", "heartbeat_last_id")


def nearby(frames: DataFrame, keys: Sequence[str], value: str, reach: int = 3, order: str = "record_index") -> DataFrame:
    """Values of the records at most ``reach`` record indices away, in record order."""
    halo, track = haloed(frames.select(*keys, order, value), keys, order, back=reach, ahead=reach)
    around = Window.partitionBy(*keys, track.slice).orderBy(order).rangeBetween(-reach, reach)
    return halo.withColumn("nearby", F.collect_list(value).over(around)).where("_own").drop("_own", "_slice")


def stale_intervals(changes: DataFrame, frames: DataFrame, keys: Sequence[str], threshold_seconds: float) -> DataFrame:
    """Gaps between quotes beyond the threshold and what was received strictly inside them.

    Gaps are intervals of one ordered sequence, so instead of a range join the receipt-time running counts are read at
    both ends of each gap.  Frames at one instant first collapse to their counts.  Quote gaps are taken in record order;
    a gap that runs backwards in receipt time is not stale.
    """
    gaps = cut(changes.where(F.col("gap_seconds") > threshold_seconds).select(
        *keys, F.col("record_index").alias("quote_index"), F.col("before_us"), F.col("receipt_us").alias("after_us"), "gap_seconds",
        (F.col("change") == "repeated").alias("unchanged"),
    ))
    kinds = ("frames", "trades", "heartbeats", "quotes")
    at = frames.groupBy(*keys, F.col("receipt_us").alias("t")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("channel").isin("matches", "trade")).alias("trades"),
        F.count_if(F.col("channel") == "heartbeat").alias("heartbeats"), F.count_if(F.col("channel") == "ticker").alias("quotes"),
    )
    # Probe points: strictly before the end, up to and including the start.
    ends = gaps.select(*keys, "quote_index", F.explode(F.array(
        F.struct(F.col("before_us").alias("t"), F.lit(1).alias("edge")), F.struct(F.col("after_us").alias("t"), F.lit(0).alias("edge")),
    )).alias("e")).select(*keys, "quote_index", "e.*")
    both = at.select(*keys, "t", F.lit(1).alias("_o"), *kinds, F.lit(None).cast("bigint").alias("quote_index"), F.lit(None).cast("int").alias("edge")).unionAll(
        ends.select(*keys, "t", (F.col("edge") * 2).alias("_o"), *[F.lit(0).cast("bigint") for _ in kinds], "quote_index", "edge")
    )
    summed = scan(cut(both), keys, ["t", "_o"], sums={f"_{k}": F.col(k) for k in kinds}).where("edge IS NOT NULL")
    within = summed.groupBy(*keys, "quote_index").agg(
        *[
            (F.sum(F.when(F.col("edge") == 0, F.col(f"_{k}")).otherwise(-F.col(f"_{k}")))).alias(k)
            for k in kinds
        ]
    )
    out = gaps.join(within, [*keys, "quote_index"])
    return out.withColumn("classification", stale_class(F.col("unchanged"), F.col("frames"), F.col("trades"), F.col("heartbeats")))


def stale_class(unchanged: Column, frames: Column, trades: Column, heartbeats: Column) -> Column:
    return (
        F.when(unchanged, "healthy unchanged quote").when(frames == 0, "probable feed inactivity")
        .when((heartbeats > 0) & (trades == 0), "connection quiet but heartbeat healthy")
        .when(trades > 0, "active trading without quote refresh").otherwise("insufficient evidence")
    )


def class_counts(rows: DataFrame, keys: Sequence[str] = (), kind: str = "classification") -> DataFrame:
    """Count per class, as rows."""
    return rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("occurrences"))


def class_map(rows: DataFrame, keys: Sequence[str], kind: str = "classification") -> DataFrame:
    """The same counts as one map per key."""
    entries = F.sort_array(F.collect_list(F.struct(kind, "occurrences")))
    return class_counts(rows, keys, kind).groupBy(*keys).agg(F.map_from_entries(entries).alias("classifications"))


def policy_comparison(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("session_id", "venue")) -> DataFrame:
    """Each old finding with the finding that replaces it under another policy, if any.

    Renamed findings have their own match rules; otherwise the first new finding of the same category stands in.
    """
    want_pattern = F.col("finding_id").startswith("TIMESTAMP_NEGATIVE")
    asked = old.withColumn("_key", F.when(want_pattern, "DELTA_PATTERN").otherwise(F.col("category")))
    place = Window.partitionBy(*keys, "_key").orderBy("rule_order")  # a session has at most one row per rule
    offered = new.select(*keys, "rule_order", F.col("finding_id").alias("new_id"), "category", F.col("severity").alias("new_severity"), F.col("observed_value").alias("new_observed"), F.col("threshold").alias("new_threshold"))
    options = offered.withColumn("_key", F.col("category")).unionAll(
        offered.where(F.col("new_id").contains("DELTA_PATTERN")).withColumn("_key", F.lit("DELTA_PATTERN"))
    ).withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place", "rule_order", "category")
    joined = asked.join(options, [*keys, "_key"], "left")
    kept = F.col("new_id").isNotNull()
    return joined.select(
        *keys, "finding_id", F.col("category").alias("old_category"), F.col("severity").alias("old_severity"),
        F.col("observed_value").alias("old_observed"), "new_id", F.coalesce("new_severity", F.lit("INFO")).alias("new_severity"),
        F.coalesce("new_observed", F.col("observed_value")).alias("new_observed"),
        kept.alias("still_observed"), F.when(kept, "semantic").otherwise("severity_or_grouping").alias("change_type"),
    )


def bounded_examples(rows: DataFrame, keys: Sequence[str], order: str, first: int = 10, size: int = 1 << 18) -> DataFrame:
    """First rows per key as a report shows them; sliced first so a huge key is never ranked in one task."""
    sliced_rows = rows.withColumn("_slice", F.floor(F.col(order) / size))
    local = sliced_rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order))).where(F.col("_r") <= first)
    # Only the earliest ``first`` slices can hold any of the answers.
    places = local.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where(F.col("_ahead") < first)
    return local.join(places.drop("_n"), [*keys, "_slice"]).withColumn("place", F.col("_ahead") + F.col("_r")).where(
        F.col("place") <= first
    ).drop("_slice", "_r", "_ahead")
