"""Queries over recorded campaign state, validation of tables, manifests and lineage.

Orders stand for attempts and slots of one campaign per priority; events stand for the ledger of one campaign per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.operators import campaign, identity, sync, validation
from tandemtape.operators.ordered import carry, sliced
from tandemtape.plans.frames import MARKET, market_rows
from tandemtape.plans.registry import block, query, rounded, scratch, using
from tandemtape.session import cut
from tandemtape.sources import samples, tables

NEED = campaign.Requirements(sessions=10, overlap_seconds=18_000.0, dates=3, buckets=3, attempt_overlap_seconds=900.0, maximum_attempts=2990)

# The same text builds attempts and ledger for both engines.
_STATUS = """CASE WHEN o_orderkey % 11 < 6 THEN 'ACCEPTED' WHEN o_orderkey % 11 = 6 THEN 'QUARANTINED' WHEN o_orderkey % 11 < 9 THEN 'REJECTED' WHEN o_orderkey % 11 = 9 THEN 'FAILED' ELSE 'ABORTED' END"""
_ATTEMPTS = f"""
  SELECT concat('campaign-', o_orderpriority) AS campaign_id, concat('attempt-', o_orderkey) AS attempt_id, concat('slot-', o_orderkey) AS slot_id, o_orderkey AS listed,
    {_STATUS} AS attempt_status, CASE WHEN o_orderkey % 11 < 6 AND o_orderkey % 61 <> 3 THEN 'INCLUDED' ELSE 'EXCLUDED' END AS inclusion_status,
    CASE WHEN o_orderkey % 11 = 6 THEN 'PAIRED_QUALITY_QUARANTINED' WHEN o_orderkey % 11 > 6 THEN 'ARCHIVE_VALIDATION_FAILED' END AS exclusion_reason,
    o_totalprice / 100 AS overlap_seconds, {{day}} AS planned_start_local, {{us}} AS planned_start_us, concat('bucket-', o_custkey % 4) AS time_bucket,
    CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE concat('manifests/', o_orderkey, '.json') END AS validated_pair_manifest_path,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE concat('pair-', o_orderkey) END AS paired_collection_id,
    CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE concat('s1-', o_orderkey) END AS coinbase_session_id, concat('s2-', CAST(floor(o_orderkey / 2) AS BIGINT)) AS kraken_session_id
  FROM orders"""
_SLOTS = """
  SELECT campaign_id, slot_id, planned_start_us, CASE WHEN listed % 13 = 0 THEN 'RESERVE' ELSE 'PRIMARY' END AS slot_type,
    CASE WHEN listed % 17 = 0 THEN 'MISSED' WHEN listed % 13 = 0 AND listed % 5 = 0 THEN 'PLANNED' WHEN listed % 997 = 1 THEN 'RUNNING' ELSE attempt_status END AS status,
    CASE WHEN listed % 17 = 0 THEN 'OPERATOR_UNAVAILABLE' END AS missed_reason FROM attempts"""
_LEDGER = """
  SELECT concat('campaign-', user_id % 20) AS campaign_id, event_id AS event_index, concat('slot-', CAST(floor(event_id / 7) AS BIGINT)) AS slot_id, concat('attempt-', event_id) AS attempt_id,
    CASE event_type WHEN 'signup' THEN 'CAMPAIGN_RUNTIME_MIGRATED' WHEN 'click' THEN 'ATTEMPT_STARTED' WHEN 'purchase' THEN 'ATTEMPT_ACCEPTED' WHEN 'view' THEN 'ATTEMPT_REJECTED' ELSE 'SLOT_MARKED_MISSED' END AS event_type,
    CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'ACCEPTED' WHEN 'view' THEN 'REJECTED' ELSE 'MISSED' END AS status,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('commit-', CAST(floor(event_id / 50) AS BIGINT)) END END AS new_commit,
    CASE WHEN event_type = 'click' THEN concat('commit-', CAST(floor(event_id / 50) AS BIGINT)) END AS attempt_commit,
    concat('{{"event":', event_id, ',"type":"', event_type, '"}}') AS canonical_payload
  FROM events"""
_SPARK = {"day": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm')", "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))"}
_DUCK = {"day": "strftime(o_orderdate, '%Y-%m-%d %H:%M')", "us": "epoch_us(CAST(o_orderdate AS TIMESTAMP))"}
block("attempts", _ATTEMPTS.format(**_DUCK))
block("slots", _SLOTS)
block("ledger", _LEDGER.replace("{{", "{").replace("}}", "}"))


def attempts(spark, folder) -> DataFrame:
    return spark.sql(_ATTEMPTS.format(**_SPARK).replace("FROM orders", "FROM {orders}"), orders=samples.table(spark, folder, "orders"))


def slots(spark, folder) -> DataFrame:
    return spark.sql(_SLOTS.replace("FROM attempts", "FROM {attempts}"), attempts=attempts(spark, folder))


def ledger(spark, folder) -> DataFrame:
    return spark.sql(_LEDGER.replace("FROM events", "FROM {events}"), events=samples.table(spark, folder, "events"))


_GOOD = "attempt_status = 'ACCEPTED' AND inclusion_status = 'INCLUDED'"


@query("included_attempts", using("attempts", f"""
  SELECT campaign_id, attempt_id, CASE WHEN {_GOOD} THEN 'included' ELSE 'wrongly excluded' END AS state FROM attempts WHERE attempt_status = 'ACCEPTED'"""))
def included_attempts(spark, folder):
    rows = attempts(spark, folder)
    return campaign.included(rows).select("campaign_id", "attempt_id", F.lit("included").alias("state")).unionAll(
        campaign.wrongly_excluded(rows).select("campaign_id", "attempt_id", F.lit("wrongly excluded"))
    )


@query("missing_lineage", using("attempts", f"""
  SELECT attempt_id, concat_ws(',', CASE WHEN paired_collection_id IS NULL OR paired_collection_id = '' THEN 'paired_collection_id' END,
    CASE WHEN attempt_id LIKE '%7' THEN 'validated_pair_manifest_id' END, CASE WHEN coalesce(validated_pair_manifest_path, '') = '' THEN 'validated_pair_manifest_path' END,
    CASE WHEN coalesce(coinbase_session_id, '') = '' THEN 'coinbase_session_id' END, CASE WHEN coalesce(kraken_session_id, '') = '' THEN 'kraken_session_id' END,
    'paired_quality_report_hash', CASE WHEN attempt_id LIKE '%13' THEN 'attempt_runtime_git_commit' END) AS missing
  FROM attempts WHERE {_GOOD}"""))
def missing_lineage(spark, folder):
    """All eight required fields: three are given here with gaps, one column is absent and so missing everywhere."""
    rows = campaign.included(attempts(spark, folder)).drop("paired_quality_report_hash")
    given = lambda c, end: F.when(~F.col("attempt_id").endswith(end), c)
    rows = rows.withColumns(
        {
            "validated_pair_manifest_id": given(F.lit("manifest"), "7"), "validated_pair_manifest_sha256": F.sha2("attempt_id", 256),
            "attempt_runtime_git_commit": given(F.lit("commit"), "13"),
        }
    )
    return validation.missing_fields(rows, ["attempt_id"], campaign.REQUIRED_LINEAGE).select("attempt_id", F.concat_ws(",", "missing").alias("missing"))


_VERDICT_IN = """
  SELECT o_orderkey, {a} AS archive_valid_1, {b} AS archive_valid_2, {d1} AS disposition_1, {d2} AS disposition_2, {d} AS disposition, o_totalprice / 100 AS market_overlap_seconds, o_orderkey AS market_overlap_start_us,
    o_orderkey AS first_market_1, o_orderkey + 5 AS first_market_2, o_orderkey + 100 AS last_market_1, o_orderkey + 90 AS last_market_2, concat('s1-', o_orderkey) AS session_1, concat('s2-', o_orderkey) AS session_2,
    concat('attempt-', o_orderkey) AS attempt_id FROM orders""".format(
    a="o_orderkey % 19 <> 0", b="o_orderkey % 23 <> 0", d1="CASE WHEN o_orderkey % 7 = 1 THEN 'REJECTED' ELSE 'ACCEPTED' END", d2="CASE WHEN o_orderkey % 13 = 1 THEN 'QUARANTINED' ELSE 'ACCEPTED' END",
    d="CASE WHEN o_orderkey % 13 = 1 THEN 'QUARANTINED' WHEN o_orderkey % 7 = 1 OR o_orderkey % 29 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END",
)


def judged_pairs(spark, folder) -> DataFrame:
    return spark.sql(_VERDICT_IN.replace("FROM orders", "FROM {orders}"), orders=samples.table(spark, folder, "orders"))


@query("attempt_verdicts", f"""
  SELECT attempt_id, CASE WHEN good THEN 'ACCEPTED' WHEN disposition = 'QUARANTINED' THEN 'QUARANTINED' ELSE 'REJECTED' END AS attempt_status,
    CASE WHEN good THEN NULL WHEN disposition = 'QUARANTINED' THEN 'PAIRED_QUALITY_QUARANTINED' WHEN NOT (archive_valid_1 AND archive_valid_2) THEN 'ARCHIVE_VALIDATION_FAILED'
      WHEN disposition_1 <> 'ACCEPTED' THEN 'COINBASE_QUALITY_NOT_ACCEPTED' WHEN disposition_2 <> 'ACCEPTED' THEN 'KRAKEN_QUALITY_NOT_ACCEPTED' WHEN disposition <> 'ACCEPTED' THEN 'PAIRED_QUALITY_NOT_ACCEPTED'
      WHEN market_overlap_seconds < 900 THEN 'INSUFFICIENT_PAIRED_OVERLAP' END AS exclusion_reason
  FROM (SELECT *, archive_valid_1 AND archive_valid_2 AND disposition_1 = 'ACCEPTED' AND disposition_2 = 'ACCEPTED' AND disposition = 'ACCEPTED' AND market_overlap_seconds >= 900 AS good FROM ({_VERDICT_IN}))""")
def attempt_verdicts(spark, folder):
    rows = judged_pairs(spark, folder)
    return campaign.attempt_verdict(rows.withColumn("promotable", campaign.promotable(rows)), 900.0).select("attempt_id", "attempt_status", "exclusion_reason")


@query("promotion_manifests", f"""
  SELECT concat('validated-', attempt_id) AS dataset_manifest_id, attempt_id, first_market_1 AS start_us, last_market_1 AS end_us, round(market_overlap_seconds, 4) AS market_overlap_seconds
  FROM ({_VERDICT_IN}) WHERE archive_valid_1 AND archive_valid_2 AND disposition_1 = 'ACCEPTED' AND disposition_2 = 'ACCEPTED' AND disposition = 'ACCEPTED'""")
def promotion_manifests(spark, folder):
    rows = judged_pairs(spark, folder).withColumn("market_overlap_end_us", F.col("market_overlap_start_us"))
    return rounded(campaign.promotion_manifest(rows).select("dataset_manifest_id", "attempt_id", "start_us", "end_us", "market_overlap_seconds"), 4)


@query("campaign_completion", using("attempts slots", f"""
  SELECT a.*, coalesce(open_slots, 0) AS open_slots, CASE WHEN accepted_sessions >= 10 AND accepted_overlap_seconds >= 18000 AND n_dates >= 3 AND n_buckets >= 3 AND coalesce(open_slots, 0) = 0 THEN 'SATISFIED' ELSE 'UNSATISFIED' END AS completion_status
  FROM (SELECT campaign_id, count(*) FILTER ({_GOOD}) AS accepted_sessions, sum(CAST(overlap_seconds AS DECIMAL(20,6))) FILTER ({_GOOD}) AS accepted_overlap_seconds,
      count(DISTINCT substr(planned_start_local, 1, 10)) FILTER ({_GOOD}) AS n_dates, count(DISTINCT time_bucket) FILTER ({_GOOD}) AS n_buckets FROM attempts GROUP BY 1) a
  LEFT JOIN (SELECT campaign_id, count(*) FILTER (slot_type <> 'RESERVE' AND status IN ('PLANNED', 'RUNNING')) AS open_slots FROM slots GROUP BY 1) USING (campaign_id)"""))
def campaign_completion(spark, folder):
    out = campaign.completion(attempts(spark, folder), slots(spark, folder), NEED)
    return out.select(
        "campaign_id", "accepted_sessions", "accepted_overlap_seconds", F.size("accepted_dates").cast("bigint").alias("n_dates"),
        F.size("accepted_buckets").cast("bigint").alias("n_buckets"), "open_slots", "completion_status",
    )


@query("accepted_dates_and_buckets", using("attempts", f"""
  SELECT campaign_id, array_to_string(list_sort(list(DISTINCT substr(planned_start_local, 1, 7)) FILTER ({_GOOD})), ',') AS months, array_to_string(list_sort(list(DISTINCT time_bucket) FILTER ({_GOOD})), ',') AS buckets FROM attempts GROUP BY 1"""))
def accepted_dates_and_buckets(spark, folder):
    return campaign.included(attempts(spark, folder)).groupBy("campaign_id").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.substring("planned_start_local", 1, 7)))).alias("months"),
        F.concat_ws(",", F.sort_array(F.collect_set("time_bucket"))).alias("buckets"),
    )


@query("exact_overlap_totals", using("attempts", f"""
  SELECT campaign_id, CAST(sum(CAST(overlap_seconds AS DECIMAL(20,6))) AS VARCHAR) AS overlap_seconds FROM attempts WHERE {_GOOD} GROUP BY 1"""))
def exact_overlap_totals(spark, folder):
    return campaign.included(attempts(spark, folder)).groupBy("campaign_id").agg(
        F.sum(campaign.exact_seconds(F.col("overlap_seconds"))).cast("string").alias("overlap_seconds")
    )


@query("campaign_violations", using("attempts", """
  SELECT campaign_id, attempt_id AS subject, 'accepted attempt omitted' AS violation FROM attempts WHERE attempt_status = 'ACCEPTED' AND inclusion_status <> 'INCLUDED'
  UNION ALL SELECT campaign_id, attempt_id, 'accepted attempt missing manifest' FROM attempts WHERE attempt_status = 'ACCEPTED' AND validated_pair_manifest_path = ''
  UNION ALL SELECT campaign_id, attempt_id, 'accepted attempt overlap too short' FROM attempts WHERE attempt_status = 'ACCEPTED' AND overlap_seconds < 900
  UNION ALL SELECT campaign_id, campaign_id, 'maximum attempts exceeded' FROM attempts GROUP BY 1 HAVING count(*) > 2990
  UNION ALL SELECT campaign_id, campaign_id, 'campaign config hash mismatch' FROM attempts GROUP BY 1 HAVING min(listed) % 2 = 1"""))
def campaign_violations(spark, folder):
    rows = attempts(spark, folder)
    campaigns = rows.groupBy("campaign_id").agg(F.min("listed").alias("_m")).select(
        "campaign_id", F.lit("a").alias("recorded_config_sha256"), F.when(F.col("_m") % 2 == 1, "b").otherwise("a").alias("actual_config_sha256")
    )
    return campaign.invariant_violations(rows, campaigns, NEED)


@query("campaign_status", using("attempts slots", """
  SELECT * FROM (SELECT campaign_id, count(*) FILTER (attempt_status = 'ACCEPTED') AS accepted, count(*) FILTER (attempt_status = 'QUARANTINED') AS quarantined, count(*) FILTER (attempt_status = 'REJECTED') AS rejected,
    count(*) FILTER (attempt_status = 'FAILED') AS failed FROM attempts GROUP BY 1) FULL JOIN (SELECT campaign_id, count(*) FILTER (status = 'MISSED') AS missed, count(*) FILTER (slot_type = 'RESERVE' AND status = 'PLANNED') AS reserve_slots_remaining,
    min((planned_start_us, slot_id)) FILTER (status IN ('PLANNED', 'RUNNING'))[2] AS next_slot FROM slots GROUP BY 1) USING (campaign_id)""".replace("min((planned_start_us, slot_id)) FILTER (status IN ('PLANNED', 'RUNNING'))[2]", "(min({'a': planned_start_us, 'b': slot_id}) FILTER (status IN ('PLANNED', 'RUNNING')))['b']")))
def campaign_status(spark, folder):
    return campaign.status_summary(attempts(spark, folder), slots(spark, folder))


@query("lineage_lists", using("attempts slots", f"""
  SELECT 'accepted' AS kind, campaign_id, attempt_id AS subject, planned_start_us, '' AS reason FROM attempts WHERE {_GOOD}
  UNION ALL SELECT 'excluded', campaign_id, attempt_id, planned_start_us, coalesce(exclusion_reason, '') FROM attempts WHERE inclusion_status = 'EXCLUDED' AND attempt_status <> 'ACCEPTED'
  UNION ALL SELECT 'missed', campaign_id, slot_id, planned_start_us, missed_reason FROM slots WHERE status = 'MISSED'"""))
def lineage_lists(spark, folder):
    return campaign.lineage_lists(attempts(spark, folder), slots(spark, folder))


@query("order_faults", using("attempts", """
  SELECT campaign_id, listed, planned_start_us, slot_id, attempt_id FROM (SELECT *, lag({'a': planned_start_us, 'b': slot_id, 'c': attempt_id}) OVER (PARTITION BY campaign_id ORDER BY listed) AS p FROM attempts)
  WHERE p > {'a': planned_start_us, 'b': slot_id, 'c': attempt_id}"""))
def order_faults(spark, folder):
    return campaign.order_faults(attempts(spark, folder), ["campaign_id"], "listed", ["planned_start_us", "slot_id", "attempt_id"])


@query("composite_dataset", using("attempts", f"""
  SELECT (SELECT count(DISTINCT campaign_id) FROM attempts) AS source_campaigns, true AS unique_campaigns, true AS consistent_sources, count(*) AS accepted_sessions,
    sum(CAST(overlap_seconds AS DECIMAL(20,6))) AS overlap_seconds, true AS requirements_satisfied FROM attempts WHERE {_GOOD}"""))
def composite_dataset(spark, folder):
    rows = attempts(spark, folder)
    campaigns = rows.select("campaign_id").distinct().withColumns(
        {"instrument": F.lit("BTC-USD"), "venues": F.lit("coinbase,kraken"), "quality_policy_version": F.lit("2d.2")}
    )
    return campaign.composite(rows, campaigns, NEED)


@query("repeated_sessions", using("attempts", "SELECT kraken_session_id AS session_id, count(*) AS inclusions FROM attempts GROUP BY 1 HAVING count(*) > 1"))
def repeated_sessions(spark, folder):
    return campaign.repeated_sessions(attempts(spark, folder).withColumnRenamed("kraken_session_id", "session_id"))


@query("duplicate_attempt_content", using("attempts", """
  SELECT kraken_session_id, count(*) AS seen FROM attempts GROUP BY 1 HAVING count(*) > 1"""))
def duplicate_attempt_content(spark, folder):
    return identity.repeated_ids(attempts(spark, folder), "kraken_session_id")


# --- ledger ----------------------------------------------------------------------------------------------------------
@query("latest_states", using("ledger", """
  SELECT campaign_id, slot_id, arg_max(status, event_index) AS status, max(event_index) AS event_index FROM ledger WHERE status IS NOT NULL GROUP BY 1, 2"""))
def latest_states(spark, folder):
    return campaign.latest_state(ledger(spark, folder), ["campaign_id"], "slot_id")


@query("slot_attempts", using("ledger", """
  SELECT campaign_id, slot_id, array_to_string(list(attempt_id ORDER BY event_index), ',') AS attempts FROM ledger WHERE event_type = 'ATTEMPT_STARTED' GROUP BY 1, 2"""))
def slot_attempts(spark, folder):
    return campaign.slot_attempts(ledger(spark, folder), ["campaign_id"]).withColumn("attempts", F.concat_ws(",", "attempts"))


@query("state_drift", using("ledger", """
  SELECT campaign_id, slot_id, r.status AS rebuilt_status, s.status AS stored_status FROM (SELECT campaign_id, slot_id, arg_max(status, event_index) AS status FROM ledger WHERE status IS NOT NULL GROUP BY 1, 2) r
  FULL JOIN (SELECT campaign_id, slot_id, arg_max(status, event_index) AS status FROM ledger WHERE status IS NOT NULL AND event_index % 10 <> 3 GROUP BY 1, 2) s USING (campaign_id, slot_id) WHERE r.status IS DISTINCT FROM s.status"""))
def state_drift(spark, folder):
    rows = ledger(spark, folder)
    # The stored state missed some of the events.
    stored = campaign.latest_state(rows.where("event_index % 10 <> 3"), ["campaign_id"], "slot_id")
    return campaign.state_drift(campaign.latest_state(rows, ["campaign_id"], "slot_id"), stored, ["campaign_id"], "slot_id")


@query("runtime_faults", using("ledger", """
  SELECT campaign_id, event_index, event_type, attempt_commit, expected_commit, CASE WHEN event_type = 'CAMPAIGN_RUNTIME_MIGRATED' THEN 'runtime migration missing new commit' ELSE 'attempt runtime mismatch at start' END AS fault
  FROM (SELECT *, last_value(nullif(new_commit, '') IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected_commit FROM ledger)
  WHERE (event_type = 'CAMPAIGN_RUNTIME_MIGRATED' AND new_commit = '') OR (event_type = 'ATTEMPT_STARTED' AND attempt_commit <> expected_commit)"""))
def runtime_faults(spark, folder):
    return campaign.runtime_faults(ledger(spark, folder))


@query("ledger_chain_breaks", using("ledger", """
  SELECT campaign_id, event_index, i <> coalesce(pi + 1, 0) AS index_mismatch, CASE WHEN event_index % 211 = 5 THEN 'broken' ELSE coalesce(p, 'genesis') END <> coalesce(p, 'genesis') AS previous_mismatch, event_index % 307 = 9 AS hash_mismatch
  FROM (SELECT *, lag(i) OVER w AS pi, lag(h) OVER w AS p FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY event_index) - 1 + CAST(event_index % 401 = 7 AS INT) AS i,
      CASE WHEN event_index % 307 = 9 THEN 'forged' ELSE sha256(canonical_payload) END AS h FROM ledger) WINDOW w AS (PARTITION BY campaign_id ORDER BY event_index))
  WHERE i <> coalesce(pi + 1, 0) OR event_index % 211 = 5 OR event_index % 307 = 9"""))
def ledger_chain_breaks(spark, folder):
    rows = ledger(spark, folder).withColumn(
        "event_hash", F.when(F.col("event_index") % 307 == 9, "forged").otherwise(F.sha2("canonical_payload", 256))
    )
    placed, track = sliced(rows, ["campaign_id"], ["event_index"], "event_index")
    built = carry(placed, track, before={"_h": F.col("event_hash")}, sums={"_n": F.lit(1).cast("bigint")})
    # The ledger as recorded: own numbering per campaign, with a few broken links.
    written = cut(built.select(
        "campaign_id", F.col("event_index").alias("source_index"), "canonical_payload", "event_hash",
        (F.col("_n") - 1 + (F.col("event_index") % 401 == 7).cast("int")).alias("number"),
        F.when(F.col("event_index") % 211 == 5, "broken").otherwise(F.coalesce("_h", F.lit("genesis"))).alias("previous_hash"),
    ))
    return identity.chain_breaks(written, "campaign_id", "genesis", order="source_index", number="number").withColumnRenamed("source_index", "event_index")


# --- validation ------------------------------------------------------------------------------------------------------
@query("trade_table_checks", """
  SELECT l_returnflag AS session_id, count(*) AS rows, count(*) FILTER (l_discount <= 0) AS bad_prices, count(*) FILTER (l_quantity <= 0) AS bad_quantities, count(*) FILTER (l_tax <= 0) AS bad_notionals,
    count(*) FILTER (l_linenumber = 7) AS null_ids, count(*) FILTER (l_orderkey % 10 = 0) AS missing_times,
    (CAST(count(*) FILTER (l_discount <= 0) > 0 AS INT) + CAST(count(*) FILTER (l_quantity <= 0) > 0 AS INT) + CAST(count(*) FILTER (l_tax <= 0) > 0 AS INT) + CAST(count(*) FILTER (l_linenumber = 7) > 0 AS INT)) AS error_count FROM lineitem GROUP BY 1""")
def trade_table_checks(spark, folder):
    rows = samples.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("session_id"), F.col("l_discount").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("notional"),
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("normalized_event_id"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_shipdate")).alias("exchange_timestamp_utc"),
    )
    out = validation.trade_checks(rows, ["session_id"])
    return out.withColumn("error_count", F.size("errors").cast("bigint")).drop("errors", "is_valid")


@query("quote_table_checks", using(MARKET, """
  SELECT session_id, count(*) AS rows, count(*) FILTER (bid <= 0) AS bad_bids, count(*) FILTER (ask <= 0) AS bad_asks, count(*) FILTER (bid_size < 0) AS bad_bid_sizes, count(*) FILTER (ask_size < 0) AS bad_ask_sizes,
    CAST(0 AS BIGINT) AS null_ids, count(*) FILTER (ts_us IS NULL) AS missing_times, count(*) FILTER (bid = ask) AS locked, count(*) FILTER (ask < bid) AS crossed, true AS is_valid FROM market WHERE kind = 'quote' GROUP BY 1"""))
def quote_table_checks(spark, folder):
    rows = market_rows(spark, folder, "quote").withColumns({c: F.col(c).try_cast("decimal(38,18)") for c in ("bid_price", "bid_size", "ask_price", "ask_size")})
    rows = rows.withColumns({
        "normalized_event_id": F.col("record_index"), "exchange_timestamp_utc": F.col("event_ts"),
        "locked_market_indicator": F.col("bid_price") == F.col("ask_price"), "crossed_market_indicator": F.col("ask_price") < F.col("bid_price"),
    })
    return validation.quote_checks(rows, ["session_id"]).drop("errors")


@query("validity_levels", """
  WITH f AS (SELECT l_orderkey AS session_id, l_orderkey % 100 AS attempt_id, bool_and(l_quantity > 1) AS ok FROM lineitem GROUP BY 1, 2)
  SELECT 'session' AS level, CAST(session_id AS VARCHAR) AS name, ok AS is_valid FROM f UNION ALL SELECT 'attempt', CAST(attempt_id AS VARCHAR), bool_and(ok) FROM f GROUP BY 2 UNION ALL SELECT 'dataset', 'ALL', bool_and(ok) FROM f""")
def validity_levels(spark, folder):
    rows = samples.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"), (F.col("l_orderkey") % 100).cast("string").alias("attempt_id"), (F.col("l_quantity") > 1).alias("is_valid")
    )
    return validation.propagate(rows, rows)


@query("manifest_count_reconciliation", """
  SELECT p AS table_name, e AS expected, a AS actual, CASE WHEN a IS NULL THEN 'MISSING' WHEN e IS NULL THEN 'UNLISTED' WHEN e <> a THEN 'MISMATCH' ELSE 'EQUAL' END AS state
  FROM (SELECT o_custkey AS p, count(*) AS e FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1) FULL JOIN (SELECT o_custkey AS p, count(*) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) USING (p)""")
def manifest_count_reconciliation(spark, folder):
    rows = samples.table(spark, folder, "orders")
    count = lambda df: df.groupBy(F.col("o_custkey").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))
    return validation.reconcile_counts(count(rows.where("o_custkey % 9 <> 0")), count(rows.where("o_orderstatus <> 'P'")))


@query("lineage_agreement", """
  SELECT o_custkey, count(*) AS documents, concat_ws(',', CASE WHEN min(o_orderstatus) <> max(o_orderstatus) THEN 'o_orderstatus' END, CASE WHEN min(o_orderpriority) <> max(o_orderpriority) THEN 'o_orderpriority' END) AS differing,
    min(o_orderstatus) = max(o_orderstatus) AND min(o_orderpriority) = max(o_orderpriority) AS agrees FROM orders GROUP BY 1""")
def lineage_agreement(spark, folder):
    out = validation.lineage_agreement(samples.table(spark, folder, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("differing", F.concat_ws(",", "differing"))


@query("time_diagnostics", using("base ticks", """
  SELECT session_id, count(*) AS row_count, count(*) FILTER (t IS NULL) AS missing_times, count(t) - count(DISTINCT t) AS repeated_times, min(t) AS first_us, max(t) AS last_us
  FROM (SELECT session_id, CASE WHEN k % 20 <> 0 THEN ts_us // 60000000 * 60000000 END AS t FROM ticks) GROUP BY 1"""))
def time_diagnostics(spark, folder):
    rows = samples.ticks(spark, folder).select("session_id", F.when(F.col("k") % 20 != 0, F.floor(F.col("ts_us") / 60000000) * 60000000).alias("ts_us"))
    return validation.time_diagnostics(rows, ["session_id"])


@query("readiness", using("base ticks bounds", """
  SELECT attempt_id, round((end_us - start_us) / 1e6, 6) AS overlap_seconds, (end_us - start_us) / 1e6 >= 1800 AS is_valid, CASE WHEN (end_us - start_us) / 1e6 < 1800 THEN 'short' END AS failure_reason FROM bounds"""))
def readiness(spark, folder):
    return validation.readiness(sync.overlap(samples.ticks(spark, folder)))


@query("readiness_flags", using("base ticks bounds", """
  SELECT 'STRUCTURALLY_VALID' AS structural_readiness, CASE WHEN v > 0 THEN 'PRELIMINARY_READY' ELSE 'PRELIMINARY_NOT_READY' END AS preliminary_readiness,
    CASE WHEN v >= 10 AND t >= 18000 THEN 'FINAL_COMPOSITE_SATISFIED' ELSE 'FINAL_COMPOSITE_UNSATISFIED' END AS final_composite_readiness, v AS valid_attempts, t AS total_overlap_seconds
  FROM (SELECT count(*) FILTER ((end_us - start_us) / 1e6 >= 1800) AS v, sum(CAST((end_us - start_us) / 1e6 AS DECIMAL(20,6))) AS t FROM bounds)"""))
def readiness_flags(spark, folder):
    return validation.readiness_flags(sync.overlap(samples.ticks(spark, folder)))


@query("required_minus_present", """
  SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def required_minus_present(spark, folder):
    rows = samples.table(spark, folder, "orders")
    return validation.required_minus_present(rows.select("o_custkey"), rows.where("o_orderstatus = 'P'").select("o_custkey"))


@query("result_tables_roundtrip", using("base ticks bounds", "SELECT 'overlap' AS name, count(*) AS rows, sum(end_us) AS total FROM bounds UNION ALL SELECT 'empty', 0, NULL"))
def result_tables_roundtrip(spark, folder):
    overlap = sync.overlap(samples.ticks(spark, folder))
    root = scratch(spark, "results")
    tables.write_results({"overlap": overlap, "empty": overlap.where("end_us < 0")}, root)
    read = lambda n: tables.read_table(spark, f"{root}/{n}", overlap.schema, ["end_us"]).agg(F.count(F.lit(1)).alias("rows"), F.sum("end_us").alias("total")).select(F.lit(n).alias("name"), "rows", "total")
    return read("overlap").unionAll(read("empty"))
