"""Checks of normalized tables: prices, ids, manifests, lineage and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Readiness requirements.
MINIMUM_ATTEMPT_OVERLAP_S = 1800.0
MINIMUM_TOTAL_OVERLAP_S = 18_000.0
MINIMUM_ATTEMPTS = 10


def trade_checks(trades: DataFrame, keys: Sequence[str], ts: str = "exchange_timestamp_utc") -> DataFrame:
    """Errors per group: non-positive price, quantity or notional, null id.  Missing times are only counted."""
    bad = lambda c: F.count_if(F.col(c) <= 0)
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), bad("price").alias("bad_prices"), bad("quantity").alias("bad_quantities"),
        bad("notional").alias("bad_notionals"), F.count_if(F.col("normalized_event_id").isNull()).alias("null_ids"),
        F.count_if(F.col(ts).isNull()).alias("missing_times"),
    )
    return _with_errors(out, {
        "bad_prices": "invalid trade prices <= 0", "bad_quantities": "invalid trade quantities <= 0",
        "bad_notionals": "invalid trade notionals <= 0", "null_ids": "null normalized_event_id in trade output",
    })


def quote_checks(quotes: DataFrame, keys: Sequence[str], ts: str = "exchange_timestamp_utc") -> DataFrame:
    """Errors per group: non-positive prices, negative sizes, null id.  Locked and crossed quotes are only counted."""
    out = quotes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("bid_price") <= 0).alias("bad_bids"), F.count_if(F.col("ask_price") <= 0).alias("bad_asks"),
        F.count_if(F.col("bid_size") < 0).alias("bad_bid_sizes"), F.count_if(F.col("ask_size") < 0).alias("bad_ask_sizes"),
        F.count_if(F.col("normalized_event_id").isNull()).alias("null_ids"), F.count_if(F.col(ts).isNull()).alias("missing_times"),
        F.count_if("locked_market_indicator").alias("locked"), F.count_if("crossed_market_indicator").alias("crossed"),
    )
    return _with_errors(out, {
        "bad_bids": "invalid BBO bid_price <= 0", "bad_asks": "invalid BBO ask_price <= 0",
        "bad_bid_sizes": "invalid BBO bid_size < 0", "bad_ask_sizes": "invalid BBO ask_size < 0",
        "null_ids": "null normalized_event_id in BBO output",
    })


def _with_errors(out: DataFrame, texts: dict[str, str]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.col(c) > 0, t) for c, t in texts.items()]), lambda x: x.isNotNull())
    return out.withColumn("errors", found).withColumn("is_valid", F.size("errors") == 0)


def propagate(files: DataFrame, sessions: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Validity from files to sessions to attempts to the whole set, as rows (level, name, is_valid)."""
    at_session = files.groupBy("session_id").agg(F.bool_and("is_valid").alias("is_valid"))
    at_attempt = at_session.join(sessions.select("session_id", attempt).distinct(), "session_id").groupBy(attempt).agg(
        F.bool_and("is_valid").alias("is_valid")
    )
    whole = at_attempt.agg(F.bool_and("is_valid").alias("is_valid"))
    return (
        at_session.select(F.lit("session").alias("level"), F.col("session_id").alias("name"), "is_valid")
        .unionAll(at_attempt.select(F.lit("attempt"), attempt, "is_valid"))
        .unionAll(whole.select(F.lit("dataset"), F.lit("ALL"), "is_valid"))
    )


def reconcile_counts(manifest: DataFrame, actual: DataFrame, key: str = "table_name") -> DataFrame:
    """Row counts the manifest names against the counts found: missing, extra, mismatch or equal."""
    joined = manifest.select(key, F.col("row_count").alias("expected")).join(
        actual.select(key, F.col("row_count").alias("actual")), key, "full"
    )
    return joined.withColumn("state", compared(F.col("expected"), F.col("actual")))


def compared(expected: Column, actual: Column) -> Column:
    return (
        F.when(actual.isNull(), "MISSING").when(expected.isNull(), "UNLISTED").when(expected != actual, "MISMATCH").otherwise("EQUAL")
    )


def compare_files(manifest: DataFrame, actual: DataFrame, path: str = "relative_path") -> DataFrame:
    """Manifest entries against files: both hashes and what is missing, unlisted or different."""
    joined = manifest.select(path, F.col("sha256").alias("expected_sha256")).join(
        actual.select(path, F.col("sha256").alias("actual_sha256")), path, "full"
    )
    return joined.withColumn("state", compared(F.col("expected_sha256"), F.col("actual_sha256")))


def lineage_agreement(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Whether each lineage value is the same in every document of a group; names the ones that differ.

    ``rows`` holds one row per document (manifest, catalog, snapshot); a null never agrees with a value.
    """
    marked = [F.coalesce(F.col(c), F.lit("\x00")) for c in columns]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        *[(F.min(m) != F.max(m)).alias(f"_d_{c}") for c, m in zip(columns, marked)],
    )
    differing = F.filter(F.array(*[F.when(F.col(f"_d_{c}"), c) for c in columns]), lambda x: x.isNotNull())
    return out.select(*keys, "documents", differing.alias("differing"), (F.size(differing) == 0).alias("agrees"))


def missing_fields(rows: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows whose required lineage has null or empty values, with the names of those values; an absent column is missing in all."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "") if c in rows.columns else F.lit(True)
    names = F.filter(F.array(*[F.when(blank(c), c) for c in required]), lambda x: x.isNotNull())
    return rows.select(*keys, names.alias("missing")).where(F.size("missing") > 0)


def time_diagnostics(rows: DataFrame, keys: Sequence[str], ts: str = "ts_us") -> DataFrame:
    """Rows, missing and repeated times, first and last time per session."""
    per_time = rows.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("row_count"), F.coalesce(F.sum(F.when(F.col(ts).isNull(), F.col("_n"))), F.lit(0)).alias("missing_times"),
        F.coalesce(F.sum(F.when(F.col(ts).isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("repeated_times"),
        F.min(ts).alias("first_us"), F.max(ts).alias("last_us"),
    )


def readiness(overlaps: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Attempts with their validity flag and the reason when not valid."""
    enough = F.col("overlap_seconds") >= MINIMUM_ATTEMPT_OVERLAP_S
    return overlaps.select(
        attempt, F.round("overlap_seconds", 6).alias("overlap_seconds"), enough.alias("is_valid"),
        F.when(~enough, F.concat(F.lit("overlap "), F.format_string("%.1f", "overlap_seconds"), F.lit(f"s < threshold {MINIMUM_ATTEMPT_OVERLAP_S:.0f}s"))).alias("failure_reason"),
    )


def readiness_flags(overlaps: DataFrame, dataset_valid: bool = True) -> DataFrame:
    valid = F.count_if(F.col("overlap_seconds") >= MINIMUM_ATTEMPT_OVERLAP_S)
    met = (valid >= MINIMUM_ATTEMPTS) & (F.sum("overlap_seconds") >= MINIMUM_TOTAL_OVERLAP_S)
    return overlaps.agg(
        F.lit("STRUCTURALLY_VALID" if dataset_valid else "STRUCTURALLY_INVALID").alias("structural_readiness"),
        F.when(valid > 0, "PRELIMINARY_READY").otherwise("PRELIMINARY_NOT_READY").alias("preliminary_readiness"),
        F.when(met, "FINAL_COMPOSITE_SATISFIED").otherwise("FINAL_COMPOSITE_UNSATISFIED").alias("final_composite_readiness"),
        valid.alias("valid_attempts"), F.sum(F.round("overlap_seconds", 6).cast("decimal(20,6)")).alias("total_overlap_seconds"),
    )


def required_minus_present(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required names that are not there."""
    return required.distinct().join(present.distinct(), required.columns, "left_anti")
