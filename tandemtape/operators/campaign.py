"""Recorded campaign state: attempts, slots, ledger events, completion, manifests and composites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.operators.ordered import carry, sliced

# States as recorded.
TERMINAL = ("ACCEPTED", "QUARANTINED", "REJECTED", "FAILED", "ABORTED", "MISSED", "NOT_NEEDED")
REQUIRED_LINEAGE = (
    "paired_collection_id", "validated_pair_manifest_id", "validated_pair_manifest_path", "validated_pair_manifest_sha256",
    "coinbase_session_id", "kraken_session_id", "paired_quality_report_hash", "attempt_runtime_git_commit",
)


@dataclass(frozen=True)
class Requirements:
    sessions: int = 10
    overlap_seconds: float = 18_000.0
    dates: int = 3
    buckets: int = 3
    attempt_overlap_seconds: float = 1800.0
    maximum_attempts: int = 50


def exact_seconds(value: Column) -> Column:
    return F.bround(value.cast("decimal(26,9)"), 6).cast("decimal(20,6)")


def included(attempts: DataFrame) -> DataFrame:
    """Accepted and included attempts."""
    return attempts.where("attempt_status = 'ACCEPTED' AND inclusion_status = 'INCLUDED'")


def wrongly_excluded(attempts: DataFrame) -> DataFrame:
    """Accepted attempts that are not included: a catalog must refuse them."""
    return attempts.where("attempt_status = 'ACCEPTED' AND inclusion_status <> 'INCLUDED'")


def attempt_verdict(pairs: DataFrame, minimum_overlap_seconds: float) -> DataFrame:
    """Attempt status and the first failing test.  Needs archive and disposition columns of both sessions and the pair."""
    accepted = lambda c: F.col(c) == "ACCEPTED"
    overlap = F.col("market_overlap_seconds")
    all_good = (
        F.col("archive_valid_1") & F.col("archive_valid_2") & accepted("disposition_1") & accepted("disposition_2")
        & accepted("disposition") & (overlap >= minimum_overlap_seconds) & F.col("promotable")
    )
    held = F.col("disposition") == "QUARANTINED"
    first_failure = (
        F.when(held, "PAIRED_QUALITY_QUARANTINED")
        .when(~(F.col("archive_valid_1") & F.col("archive_valid_2")), "ARCHIVE_VALIDATION_FAILED")
        .when(~accepted("disposition_1"), "COINBASE_QUALITY_NOT_ACCEPTED")
        .when(~accepted("disposition_2"), "KRAKEN_QUALITY_NOT_ACCEPTED")
        .when(~accepted("disposition"), "PAIRED_QUALITY_NOT_ACCEPTED")
        .when(overlap < minimum_overlap_seconds, "INSUFFICIENT_PAIRED_OVERLAP")
        .otherwise("PROMOTION_DRY_RUN_BLOCKED")
    )
    good = F.coalesce(all_good, F.lit(False))
    return pairs.withColumn(
        "attempt_status", F.when(good, "ACCEPTED").when(held, "QUARANTINED").otherwise("REJECTED")
    ).withColumn("inclusion_status", F.when(good, "INCLUDED").otherwise("EXCLUDED")).withColumn(
        "exclusion_reason", F.when(~good, first_failure)
    )


def promotable(pairs: DataFrame) -> Column:
    """Pair and both sessions accepted, archives valid, overlap present."""
    return F.coalesce(
        (F.col("disposition") == "ACCEPTED") & (F.col("disposition_1") == "ACCEPTED") & (F.col("disposition_2") == "ACCEPTED")
        & F.col("archive_valid_1") & F.col("archive_valid_2") & F.col("market_overlap_start_us").isNotNull(),
        F.lit(False),
    )


def promotion_manifest(pairs: DataFrame, pair: str = "attempt_id") -> DataFrame:
    """Manifest row of every pair that may be promoted: earliest start, latest end, overlap."""
    return pairs.where(promotable(pairs)).select(
        F.concat(F.lit("validated-"), F.col(pair)).alias("dataset_manifest_id"), pair, "session_1", "session_2",
        F.least("first_market_1", "first_market_2").alias("start_us"), F.greatest("last_market_1", "last_market_2").alias("end_us"),
        "market_overlap_start_us", "market_overlap_end_us", "market_overlap_seconds",
    )


def completion(attempts: DataFrame, slots: DataFrame, need: Requirements, keys: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """One verdict row per campaign against the minima; every slot but reserves must be in a terminal state."""
    good = (F.col("attempt_status") == "ACCEPTED") & (F.col("inclusion_status") == "INCLUDED")
    day = F.split("planned_start_local", " ")[0]
    # Distinct dates and buckets of a campaign are few; the sets are built by map-side combined aggregates.
    counted = attempts.groupBy(*keys).agg(
        F.count_if(good).alias("accepted_sessions"),
        F.coalesce(F.sum(F.when(good, exact_seconds(F.col("overlap_seconds")))), F.lit(0)).cast("decimal(26,6)").alias("accepted_overlap_seconds"),
        F.sort_array(F.collect_set(F.when(good, day))).alias("accepted_dates"),
        F.sort_array(F.collect_set(F.when(good, F.col("time_bucket")))).alias("accepted_buckets"),
    )
    open_slots = slots.groupBy(*keys).agg(
        F.count_if((F.col("slot_type") != "RESERVE") & ~F.col("status").isin(*TERMINAL)).alias("open_slots")
    )
    out = counted.join(open_slots, list(keys), "left")
    tests = {
        "enough_sessions": F.col("accepted_sessions") >= need.sessions,
        "enough_overlap": F.col("accepted_overlap_seconds") >= need.overlap_seconds,
        "enough_dates": F.size("accepted_dates") >= need.dates,
        "enough_buckets": F.size("accepted_buckets") >= need.buckets,
        "attempts_registered": F.coalesce("open_slots", F.lit(0)) == 0,
    }
    met = F.lit(True)
    for c in tests.values():
        met = met & c
    return out.withColumns(tests).withColumn("completion_status", F.when(met, "SATISFIED").otherwise("UNSATISFIED"))


def invariant_violations(attempts: DataFrame, campaigns: DataFrame, need: Requirements) -> DataFrame:
    """Broken campaign rules, one row each: hash drift, attempt cap, accepted attempts without what they need."""
    accepted = attempts.where("attempt_status = 'ACCEPTED'")
    attempt = F.col("attempt_id")
    broken = accepted.select(
        "campaign_id", attempt.alias("subject"),
        F.explode(F.filter(F.array(
            F.when(F.col("inclusion_status") != "INCLUDED", "accepted attempt omitted"),
            F.when(F.coalesce("validated_pair_manifest_path", F.lit("")) == "", "accepted attempt missing manifest"),
            F.when(F.col("overlap_seconds") < need.attempt_overlap_seconds, "accepted attempt overlap too short"),
        ), lambda x: x.isNotNull())).alias("violation"),
    )
    crowded = attempts.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > need.maximum_attempts)
    drift = campaigns.where("recorded_config_sha256 <> actual_config_sha256")
    return broken.unionAll(
        crowded.select("campaign_id", F.col("campaign_id"), F.lit("maximum attempts exceeded"))
    ).unionAll(drift.select("campaign_id", F.col("campaign_id"), F.lit("campaign config hash mismatch")))


def latest_state(events: DataFrame, keys: Sequence[str], entity: str, status: str = "status") -> DataFrame:
    """Latest recorded status per slot or attempt; events without one leave it as it was."""
    return events.where(F.col(status).isNotNull() & F.col(entity).isNotNull()).groupBy(*keys, entity).agg(
        F.max_by(status, "event_index").alias(status), F.max("event_index").alias("event_index")
    )


def slot_attempts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempts started in each slot, in order.  A slot has few attempts."""
    started = events.where("event_type = 'ATTEMPT_STARTED'")
    return started.groupBy(*keys, "slot_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_index", "attempt_id"))), lambda x: x["attempt_id"]).alias("attempts")
    )


def state_drift(rebuilt: DataFrame, stored: DataFrame, keys: Sequence[str], entity: str, status: str = "status") -> DataFrame:
    """Entities whose stored status differs from the one rebuilt from events."""
    a = rebuilt.select(*keys, entity, F.col(status).alias("rebuilt_status"))
    b = stored.select(*keys, entity, F.col(status).alias("stored_status"))
    joined = a.join(b, [*keys, entity], "full")
    return joined.where(~F.col("rebuilt_status").eqNullSafe(F.col("stored_status")))


def status_summary(attempts: DataFrame, slots: DataFrame) -> DataFrame:
    """Counts by status, reserves left and the first slot not yet in a terminal state, per campaign."""
    n = lambda s: F.count_if(F.col("attempt_status") == s)
    by_attempt = attempts.groupBy("campaign_id").agg(
        n("ACCEPTED").alias("accepted"), n("QUARANTINED").alias("quarantined"), n("REJECTED").alias("rejected"), n("FAILED").alias("failed"),
    )
    opened = F.when(~F.col("status").isin(*TERMINAL), F.struct("planned_start_us", "slot_id"))
    by_slot = slots.groupBy("campaign_id").agg(
        F.count_if(F.col("status") == "MISSED").alias("missed"),
        F.count_if((F.col("slot_type") == "RESERVE") & (F.col("status") == "PLANNED")).alias("reserve_slots_remaining"),
        F.min(opened)["slot_id"].alias("next_slot"),
    )
    return by_attempt.join(by_slot, "campaign_id", "full")


def lineage_lists(attempts: DataFrame, slots: DataFrame) -> DataFrame:
    """Accepted, excluded and missed entries with reasons, as one table ordered within each kind by the planned start."""
    accepted = included(attempts).select(
        F.lit("accepted").alias("kind"), "campaign_id", F.col("attempt_id").alias("subject"), "planned_start_us", F.lit("").alias("reason")
    )
    excluded = attempts.where("inclusion_status = 'EXCLUDED' AND attempt_status <> 'ACCEPTED'").select(
        F.lit("excluded"), "campaign_id", "attempt_id", "planned_start_us", F.coalesce("exclusion_reason", F.lit(""))
    )
    missed = slots.where("status = 'MISSED'").select(
        F.lit("missed"), "campaign_id", "slot_id", "planned_start_us", F.coalesce("missed_reason", F.lit(""))
    )
    return accepted.unionAll(excluded).unionAll(missed)


def order_faults(rows: DataFrame, keys: Sequence[str], index: str, order: Sequence[str]) -> DataFrame:
    """Rows listed before one they should follow, by (planned start, slot, attempt)."""
    placed, track = sliced(rows, keys, [index], index)
    held = carry(placed, track, before={"_p": F.struct(*order)})
    return held.where(F.col("_p") > F.struct(*order)).select(*keys, index, *order)


def composite(attempts: DataFrame, campaigns: DataFrame, need: Requirements) -> DataFrame:
    """Accepted attempts of several campaigns as one set: shared instrument, venues and policy, totals against need."""
    one = lambda c: F.min(c) == F.max(c)
    shared = campaigns.agg(
        F.count(F.lit(1)).alias("source_campaigns"), (F.count(F.lit(1)) == F.count_distinct("campaign_id")).alias("unique_campaigns"),
        (one("instrument") & one("venues") & one("quality_policy_version")).alias("consistent_sources"),
    )
    # One row in, one row out: a two-row union folded by max, instead of a join.
    totals = included(attempts).agg(
        F.count(F.lit(1)).alias("accepted_sessions"),
        F.coalesce(F.sum(exact_seconds(F.col("overlap_seconds"))), F.lit(0)).cast("decimal(26,6)").alias("overlap_seconds"),
    )
    merged = shared.unionByName(totals, allowMissingColumns=True)
    out = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
    return out.withColumn(
        "requirements_satisfied",
        F.col("unique_campaigns") & F.col("consistent_sources") & (F.col("source_campaigns") >= 2)
        & (F.col("accepted_sessions") >= need.sessions) & (F.col("overlap_seconds") >= need.overlap_seconds),
    )


def repeated_sessions(memberships: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions included by more than one set."""
    return memberships.groupBy(session).agg(F.count(F.lit(1)).alias("inclusions")).where("inclusions > 1")


def runtime_faults(events: DataFrame, keys: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Attempts started under another commit than the one in force, and migrations without a new commit.

    The commit in force is the latest one set by an earlier initialisation or migration event.
    """
    sets = F.col("event_type").isin("CAMPAIGN_INITIALIZED") | F.col("event_type").startswith("CAMPAIGN_RUNTIME_MIGRATED")
    placed, track = sliced(events, keys, ["event_index"], "event_index")
    commit = F.nullif(F.col("new_commit"), F.lit(""))
    held = carry(placed, track, before={"expected_commit": (commit, sets & commit.isNotNull())})
    mismatch = (F.col("event_type") == "ATTEMPT_STARTED") & (F.col("attempt_commit") != F.col("expected_commit"))
    blank = F.col("event_type").startswith("CAMPAIGN_RUNTIME_MIGRATED") & commit.isNull()
    return held.where(F.coalesce(mismatch, F.lit(False)) | blank).select(
        *keys, "event_index", "event_type", "attempt_commit", "expected_commit",
        F.when(blank, "runtime migration missing new commit").otherwise("attempt runtime mismatch at start").alias("fault"),
    )
