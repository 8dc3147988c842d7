"""Session quality: metrics from frames and events, findings, dispositions, pairs and overlap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.functions import payload as P
from tandemtape.functions.quantiles import exact_quantiles
from tandemtape.operators import identity
from tandemtape.operators.ordered import carry, sliced
from tandemtape.schemas import VENUE_1, VENUE_2
from tandemtape.session import cut


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds and severities.  Fixed values: the published defaults."""

    version: str = "2d.2"
    max_parse_error_rate: float = 0.001
    max_unsupported_rate: float = 0.01
    minimum_session_seconds: float = 120.0
    minimum_frames: int = 100
    minimum_trades: int = 1
    minimum_quotes: int = 10
    max_reversed_receipts: int = 0
    max_missing_exchange_rate: float = 0.05
    stale_quote_seconds: float = 2.0
    max_duplicate_rate: float = 0.01
    max_duplicate_trade_rate: float = 0.001
    minimum_overlap_seconds: float = 90.0
    maximum_start_skew_seconds: float = 15.0
    delta_minimum_events: int = 30
    delta_stable_negative_rate: float = 0.8
    delta_stable_range_ms: float = 1000.0
    delta_low_variance_ms: float = 250.0
    delta_sporadic_rate: float = 0.05
    delta_unstable_range_ms: float = 3000.0

    @property
    def calibrated(self) -> bool:
        return self.version == "2d.2"


# Severity of each delta pattern, and severity order.
DELTA_SEVERITY = {
    "STABLE_OFFSET": "INFO", "LOW_VARIANCE_OFFSET": "INFO", "MIXED_DISTRIBUTION": "WARNING",
    "SPORADIC_OUTLIERS": "WARNING", "UNSTABLE_OFFSET": "WARNING", "INSUFFICIENT_EVIDENCE": "INFO",
}
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def proportion(a: Column, b: Column) -> Column:
    return F.least(F.greatest(ratio(a, b), F.lit(0.0)), F.lit(1.0))


def sequence_checks(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("record_index",)) -> DataFrame:
    """Observations, surplus ids, reversals and jumps of more than one along record order."""
    seen = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).try_cast("bigint").alias("_v"))
    placed, track = sliced(seen, keys, order, order[0])
    step = carry(placed, track, before={"_p": F.col("_v")}).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("_v") < F.col("_p")).alias("reversals"),
        F.count_if(F.col("_v") > F.col("_p") + 1).alias("jumps"),
    )
    repeats = seen.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum(F.col("_n") - 1).alias("duplicates")
    )
    return step.join(repeats, list(keys))


def receipt_order(frames: DataFrame, keys: Sequence[str], ts: str = "receipt_us", order: str = "record_index") -> DataFrame:
    """Equal and reversed receipt times, and inter-arrival of the forward ones."""
    placed, track = sliced(frames.select(*keys, order, ts), keys, [order], order)
    return carry(placed, track, before={"_p": F.col(ts)}).withColumn(
        "interarrival_ms", F.when(F.col(ts) >= F.col("_p"), (F.col(ts) - F.col("_p")) / 1000.0)
    ).withColumn("is_equal", F.col(ts) == F.col("_p")).withColumn("is_reversed", F.col(ts) < F.col("_p")).drop("_slice", "_p")


def receipt_metrics(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = receipt_order(frames, keys)
    counts = rows.groupBy(*keys).agg(
        F.count_if("is_equal").alias("equal_receipts"), F.count_if("is_reversed").alias("reversed_receipts"),
        F.min("interarrival_ms").alias("min_interarrival_ms"), F.max("interarrival_ms").alias("max_interarrival_ms"),
    )
    ranks = exact_quantiles(
        rows, keys, "interarrival_ms",
        {"median_interarrival_ms": ("linear", 0.5), "p95_interarrival_ms": ("round_even", 0.95),
         "p99_interarrival_ms": ("round_even", 0.99)},
    ).drop("n")
    return counts.join(ranks, list(keys), "left")


def exchange_order(events: DataFrame, keys: Sequence[str], ts: str = "ts_us", frame: str = "record_index", child: str = "child_index") -> DataFrame:
    """Events equal to or earlier than the last event of the frame before theirs."""
    last = events.groupBy(*keys, frame).agg(F.max(F.struct(child, ts))[ts].alias("_last"))
    placed, track = sliced(last, keys, [frame], frame)
    before = carry(placed, track, before={"_p": F.col("_last")}).select(*keys, frame, "_p")
    return events.join(before, [*keys, frame]).groupBy(*keys).agg(
        F.count_if(F.col(ts) == F.col("_p")).alias("equal_exchange_times"),
        F.count_if(F.col(ts) < F.col("_p")).alias("reversed_exchange_times"),
    )


def quote_changes(quotes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("record_index",), receipt: str = "receipt_us") -> DataFrame:
    """Per quote: what changed against the quote before, and the time since it."""
    state = F.struct("bid_price", "bid_size", "ask_price", "ask_size", F.col(receipt).alias("at"))
    columns = [*keys, *order, receipt, "bid_price", "bid_size", "ask_price", "ask_size"]
    placed, track = sliced(quotes.select(*columns), keys, order, order[0])
    rows = carry(placed, track, before={"_p": state})
    was = lambda c: F.col(c) == F.col(f"_p.{c}")
    bid, ask = was("bid_price") & was("bid_size"), was("ask_price") & was("ask_size")
    return rows.withColumn(
        "change",
        F.when(F.col("_p").isNull(), "first").when(bid & ask, "repeated").when(~bid & ask, "bid_only")
        .when(bid & ~ask, "ask_only").otherwise("both"),
    ).withColumn("same_prices", was("bid_price") & was("ask_price")).withColumn(
        "gap_seconds", (F.col(receipt) - F.col("_p.at")) / F.lit(1e6)
    ).withColumn("before_us", F.col("_p.at")).drop("_p", "_slice")


def quote_metrics(changes: DataFrame, keys: Sequence[str], stale_seconds: float) -> DataFrame:
    """Quote state changes, reversals and stale intervals (a gap beyond the threshold; its excess is stale time)."""
    stale = F.col("gap_seconds") > stale_seconds
    excess = F.when(stale, F.col("gap_seconds") - stale_seconds)
    kind = lambda k: F.count_if(F.col("change") == k)
    return changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_quote_count"),
        kind("repeated").alias("repeated_quote_state_count"), kind("bid_only").alias("bid_only_change_count"),
        kind("ask_only").alias("ask_only_change_count"), kind("both").alias("both_side_change_count"),
        F.count_if(F.col("gap_seconds") < 0).alias("timestamp_reversal_count"),
        F.count_if(F.col("bid_size") == 0).alias("zero_bid_size_count"),
        F.count_if(F.col("ask_size") == 0).alias("zero_ask_size_count"),
        F.count_if(stale).alias("stale_interval_count"),
        F.coalesce(F.sum(excess), F.lit(0.0)).alias("stale_total_seconds"),
        F.coalesce(F.max(excess), F.lit(0.0)).alias("stale_max_seconds"),
    )


def repeated_quotes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quotes identical to the one before, and quotes with equal prices but other sizes."""
    return changes.groupBy(*keys).agg(
        F.count_if(F.col("change") == "repeated").alias("identical_states"),
        F.count_if(F.col("same_prices") & (F.col("change") != "repeated")).alias("same_prices_other_sizes"),
    )


def raw_quote_shape(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over raw quote records before any validation, so refused records count too."""
    body = F.col("payload")
    first = F.col("venue") == VENUE_1
    records = F.when(first & (P.text_of(body, "type") == "ticker"), F.array(body)).when(
        ~first & (P.text_of(body, "channel") == "ticker"),
        F.filter(F.try_variant_get(body, "$.data", "array<variant>"), lambda r: P.kind(r) == "OBJECT"),
    )
    rows = classified.select(*dict.fromkeys([*keys, "venue"]), F.explode(records).alias("r"))
    pick = lambda a, b: F.when(first, P.number_of(F.col("r"), a)).otherwise(P.number_of(F.col("r"), b))
    bid, ask = pick("best_bid", "bid"), pick("best_ask", "ask")
    bid_size, ask_size = pick("best_bid_size", "bid_qty"), pick("best_ask_size", "ask_qty")
    shaped = rows.select(*keys, bid.alias("b"), ask.alias("a"), bid_size.alias("bs"), ask_size.alias("az"))
    either = lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
    return shaped.groupBy(*keys).agg(
        F.count_if(F.col("b").isNull()).alias("missing_bid_count"), F.count_if(F.col("a").isNull()).alias("missing_ask_count"),
        F.count_if(either(F.col("b") <= 0, F.col("a") <= 0)).alias("nonpositive_price_count"),
        F.count_if(either(F.col("bs") < 0, F.col("az") < 0)).alias("negative_size_count"),
        F.count_if(F.col("b") == F.col("a")).alias("locked_market_count"),
        F.count_if(F.col("b") > F.col("a")).alias("crossed_market_count"),
    )


def delta_metrics(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receipt minus exchange time in ms: count, negatives, extremes and round-half-even ranks."""
    rows = events.withColumn("delta_ms", (F.col("receipt_us") - F.col("ts_us")) / 1000.0)
    counts = rows.groupBy(*keys).agg(
        F.count("delta_ms").alias("delta_count"), F.count_if(F.col("delta_ms") < 0).alias("delta_negative_count"),
        F.min("delta_ms").alias("delta_min_ms"), F.max("delta_ms").alias("delta_max_ms"),
    )
    ranks = exact_quantiles(
        rows, keys, "delta_ms",
        {"delta_median_ms": ("linear", 0.5), "delta_p95_ms": ("round_even", 0.95), "delta_p99_ms": ("round_even", 0.99)},
    ).drop("n")
    return counts.join(ranks, list(keys), "left")


def delta_pattern(policy: QualityPolicy) -> Column:
    """Calibrated pattern of the exchange-receipt delta.  The cut-offs apply to max - min and |p95 - median|."""
    n = F.col("delta_count")
    negative = proportion(F.col("delta_negative_count"), n)
    whole = F.col("delta_max_ms") - F.col("delta_min_ms")
    upper = F.abs(F.col("delta_p95_ms") - F.col("delta_median_ms"))
    return (
        F.when(n.isNull() | (n < policy.delta_minimum_events), "INSUFFICIENT_EVIDENCE")
        .when((negative >= policy.delta_stable_negative_rate) & (whole <= policy.delta_stable_range_ms), "STABLE_OFFSET")
        .when(upper <= policy.delta_low_variance_ms, "LOW_VARIANCE_OFFSET")
        .when(negative <= policy.delta_sporadic_rate, "SPORADIC_OUTLIERS")
        .when(whole >= policy.delta_unstable_range_ms, "UNSTABLE_OFFSET")
        .otherwise("MIXED_DISTRIBUTION")
    )


def coverage(classified: DataFrame, trades: DataFrame, quotes: DataFrame, keys: Sequence[str] = ("session_id", "venue")) -> DataFrame:
    """Totals, rates and first/last event times per session; the duration is last minus first receipt."""
    kind = F.col("result_kind")
    frames = classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("raw_frame_byte_length").alias("archive_bytes"),
        F.count_if(kind.isin("undecodable", "not_object", "invalid")).alias("parse_errors"),
        F.count_if(kind == "unsupported").alias("unsupported_messages"), F.count_if(kind == "error").alias("exchange_errors"),
        F.count_if(kind.isin("heartbeat", "acknowledgement", "status", "control")).alias("control_messages"),
        F.count_if(kind == "acknowledgement").alias("acknowledgements"),
        ((F.max("receipt_us") - F.min("receipt_us")) / F.lit(1e6)).alias("duration_seconds"),
    )
    marked = trades.select(*keys, "receipt_us", F.lit(1).alias("_t")).unionAll(quotes.select(*keys, "receipt_us", F.lit(0)))
    events = marked.groupBy(*keys).agg(
        F.sum("_t").alias("trades"), F.sum(1 - F.col("_t")).alias("quotes"),
        F.min("receipt_us").alias("first_market_us"), F.max("receipt_us").alias("last_market_us"),
        F.min(F.when(F.col("_t") == 0, F.col("receipt_us"))).alias("first_quote_us"),
        F.max(F.when(F.col("_t") == 0, F.col("receipt_us"))).alias("last_quote_us"),
    )
    out = frames.join(events, list(keys), "left").na.fill(0, ["trades", "quotes"])
    seconds = F.col("duration_seconds")
    return out.withColumns(
        {
            "frames_per_second": ratio(F.col("frames"), seconds), "trades_per_second": ratio(F.col("trades"), seconds),
            "quotes_per_second": ratio(F.col("quotes"), seconds),
            "parse_error_rate": proportion(F.col("parse_errors"), F.greatest(F.col("frames"), F.lit(1))),
            "unsupported_rate": proportion(F.col("unsupported_messages"), F.greatest(F.col("frames"), F.lit(1))),
        }
    )


EVENT_ORDER = ("record_index", "child_index")


def session_metrics(
    classified: DataFrame, trades: DataFrame, quotes: DataFrame, archive: DataFrame, policy: QualityPolicy,
    keys: Sequence[str] = ("session_id", "venue"),
) -> DataFrame:
    """One metric row per session, joined from aggregates that each scan their table once.

    ``classified`` needs ``frame_hash`` and ``receipt_us``; ``trades`` and ``quotes`` are market records with times in
    microseconds; ``archive`` is the archive check with ``archive_valid`` and ``manifest_records``.
    """
    keys = list(keys)
    shape = raw_quote_shape(classified, keys)
    # What the many aggregates below need, parsed once.
    classified = cut(classified.select(*keys, "record_index", "receipt_us", "frame_hash", "result_kind", "raw_frame_byte_length"))
    trades = cut(trades.select(*keys, *EVENT_ORDER, "ts_us", "receipt_us", "trade_id", "source_sequence", "price", "quantity", "aggressor_side"))
    quotes = cut(quotes.select(*keys, *EVENT_ORDER, "ts_us", "receipt_us", "bid_price", "bid_size", "ask_price", "ask_size"))
    copies = classified.groupBy(*keys, "frame_hash").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum(F.col("_n") - 1).alias("raw_duplicate_count"), F.sum("_n").alias("_all")
    ).select(*keys, "raw_duplicate_count", proportion(F.col("raw_duplicate_count"), F.col("_all")).alias("raw_duplicate_rate"))
    content = F.concat_ws("|", "price", "quantity", "aggressor_side", F.col("ts_us").cast("string"))
    repeats = identity.trade_id_repeats(trades, keys, content, EVENT_ORDER).withColumn(
        "duplicate_trade_id_rate", proportion(F.col("duplicate_trade_id_count"), F.greatest(F.col("trades"), F.lit(1)))
    ).drop("trades")
    sequences = sequence_checks(trades, keys, "source_sequence", EVENT_ORDER)
    events = trades.select(*keys, *EVENT_ORDER, "ts_us", "receipt_us").unionAll(
        quotes.select(*keys, *EVENT_ORDER, "ts_us", "receipt_us")
    )
    changes = quote_changes(quotes, keys, EVENT_ORDER)
    parts = [
        copies, repeats, sequences, receipt_metrics(classified, keys), exchange_order(events, keys), delta_metrics(events, keys),
        quote_metrics(changes, keys, policy.stale_quote_seconds), shape,
    ]
    out = coverage(classified, trades, quotes, keys)
    for part in parts:
        out = out.join(part, keys, "left")
    # What the archive does not tell stays unknown, and the rules that need it fail.
    told = [c for c in ("writer_failures", "missing_exchange_rate") if c in archive.columns]
    known = [c for c, kind in out.dtypes if kind != "boolean" and c not in keys]
    out = out.na.fill(0, known).join(archive.select("session_id", "archive_valid", "manifest_records", *told), "session_id", "left")
    return out.withColumns({c: F.lit(v) for c, v in (("writer_failures", 0), ("missing_exchange_rate", 0.0)) if c not in told})


# One rule per finding: id, category, severity, metric, observed value, threshold, breach.
def _rules(policy: QualityPolicy) -> list[tuple]:
    c, zero = F.col, F.lit(0.0)
    old, new = F.lit(not policy.calibrated), F.lit(policy.calibrated)
    first = c("venue") == VENUE_1
    pattern = delta_pattern(policy)
    pattern_severity = F.create_map(*[F.lit(x) for kv in DELTA_SEVERITY.items() for x in kv])[pattern]
    typed = new & ~first
    info, warning, error, critical = (F.lit(s) for s in SEVERITIES)
    anomalies = c("duplicates") + c("reversals") + F.when(first, c("jumps")).otherwise(0)
    locked = c("locked_market_count") + c("crossed_market_count")
    rows = [
        ("INTEGRITY_ARCHIVE_VALIDATION_FAILED", "integrity", critical, "archive_validation_passed", c("archive_valid").cast("double"), F.lit(1.0), ~F.coalesce(c("archive_valid"), F.lit(False))),
        ("INTEGRITY_WRITER_FAILURES", "integrity", critical, "writer_failures", c("writer_failures"), zero, F.coalesce(c("writer_failures") > 0, F.lit(True))),
        ("INTEGRITY_RAW_RECORD_SHORTFALL", "integrity", critical, "raw_records", c("frames"), c("manifest_records"), F.coalesce(c("frames") < c("manifest_records"), F.lit(True))),
        ("PARSING_ERROR_RATE", "parsing", error, "parse_error_rate", c("parse_error_rate"), F.lit(policy.max_parse_error_rate), None),
        ("PARSING_UNSUPPORTED_RATE", "parsing", warning, "unsupported_message_rate", c("unsupported_rate"), F.lit(policy.max_unsupported_rate), None),
        ("COVERAGE_SESSION_TOO_SHORT", "coverage", error, "session_duration_seconds", c("duration_seconds"), F.lit(policy.minimum_session_seconds), "below"),
        ("COVERAGE_FRAMES_TOO_LOW", "coverage", error, "frames_received", c("frames"), F.lit(policy.minimum_frames), "below"),
        ("COVERAGE_TRADES_TOO_LOW", "coverage", error, "trades", c("trades"), F.lit(policy.minimum_trades), "below"),
        ("COVERAGE_TOP_OF_BOOK_TOO_LOW", "coverage", error, "top_of_book_events", c("quotes"), F.lit(policy.minimum_quotes), "below"),
        ("TIMESTAMP_RECEIPT_NONMONOTONIC", "timestamps", error, "nonmonotonic_receipt_timestamps", c("reversed_receipts"), F.lit(policy.max_reversed_receipts), None),
        ("TIMESTAMP_EXCHANGE_MISSING_RATE", "timestamps", warning, "missing_exchange_timestamp_rate", c("missing_exchange_rate"), F.lit(policy.max_missing_exchange_rate), None),
        ("TIMESTAMP_OBSERVED_EXCHANGE_RECEIPT_DELTA_PATTERN", "timestamps", pattern_severity, "observed_exchange_receipt_delta_pattern", c("delta_negative_count"), F.lit(None), new & (c("delta_negative_count") > 0)),
        ("TIMESTAMP_NEGATIVE_OBSERVED_EXCHANGE_RECEIPT_DELTA", "timestamps", warning, "negative_observed_exchange_receipt_delta_count", c("delta_negative_count"), zero, old & (c("delta_negative_count") > 0)),
        ("DUPLICATES_KRAKEN_TYPED_RAW_FRAME", "duplicates", F.when(c("duplicate_trade_id_count") > 0, warning).otherwise(info), "exact_raw_duplicate_rate", c("raw_duplicate_rate"), F.lit(policy.max_duplicate_rate), typed & (c("raw_duplicate_rate") > policy.max_duplicate_rate)),
        ("DUPLICATES_RAW_FRAME_RATE", "duplicates", warning, "exact_raw_duplicate_rate", c("raw_duplicate_rate"), F.lit(policy.max_duplicate_rate), ~typed & (c("raw_duplicate_rate") > policy.max_duplicate_rate)),
        ("DUPLICATES_TRADE_ID_RATE", "duplicates", warning, "duplicate_trade_id_rate", c("duplicate_trade_id_rate"), F.lit(policy.max_duplicate_trade_rate), None),
        ("DUPLICATES_CONFLICTING_TRADE", "duplicates", error, "conflicting_duplicate_trade_count", c("conflicting_duplicate_trade_count"), zero, None),
        ("CONTINUITY_COINBASE_PRODUCT_SEQUENCE_DIAGNOSTIC", "continuity", info, "coinbase_sequence_discontinuity_count", c("jumps"), F.lit(None), new & first & (c("jumps") > 0)),
        ("CONTINUITY_COINBASE_NONMONOTONIC_SEQUENCE", "continuity", warning, "coinbase_nonmonotonic_sequence_count", c("reversals"), zero, new & first & (c("reversals") > 0)),
        ("CONTINUITY_KRAKEN_TRADE_ID_DIAGNOSTIC", "continuity", warning, "kraken_trade_identifier_anomaly_count", c("duplicates") + c("reversals"), zero, new & ~first & (c("duplicates") + c("reversals") > 0)),
        ("CONTINUITY_IDENTIFIER_ANOMALY", "continuity", warning, "identifier_anomaly_count", anomalies, zero, old & (anomalies > 0)),
        ("QUOTES_LOCKED_OR_CROSSED", "quotes", error, "locked_crossed_quote_count", locked, zero, None),
        ("QUOTES_AGE_DIAGNOSTIC", "quotes", info, "stale_interval_count", c("stale_interval_count"), zero, new & (c("stale_interval_count") > 0)),
        ("QUOTES_STALE_INTERVALS", "quotes", warning, "stale_interval_count", c("stale_interval_count"), zero, old & (c("stale_interval_count") > 0)),
    ]
    return rows


def findings(metrics: DataFrame, policy: QualityPolicy, keys: Sequence[str] = ("session_id", "venue")) -> DataFrame:
    """Breached rules per session: the metric row meets the whole rule table at once."""
    structs = []
    for place, (name, category, severity, metric, observed, threshold, test) in enumerate(_rules(policy)):
        seen, limit = observed.cast("double"), threshold.cast("double")
        breach = seen < limit if isinstance(test, str) else seen > limit if test is None else test
        structs.append(
            F.struct(
                F.lit(place).alias("rule_order"), F.lit(name).alias("finding_id"), F.lit(category).alias("category"),
                severity.alias("severity"), F.lit(metric).alias("metric"), seen.alias("observed_value"),
                limit.alias("threshold"), F.coalesce(breach, F.lit(False)).alias("breached"),
            )
        )
    return metrics.select(*keys, F.inline(F.array(*structs))).where("breached").drop("breached")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def disposition_from_rank(rank: Column) -> Column:
    return F.when(rank >= 3, "REJECTED").when(rank == 2, "QUARANTINED").otherwise("ACCEPTED")


def dispositions(sessions: DataFrame, found: DataFrame, keys: Sequence[str] = ("session_id", "venue")) -> DataFrame:
    """Verdict per session and the ids that decided it, in rule order."""
    rank = severity_rank(F.col("severity"))
    worst = found.groupBy(*keys).agg(
        F.max(rank).alias("_rank"),
        F.sort_array(F.collect_list(F.struct("rule_order", "finding_id", rank.alias("r")))).alias("_all"),
    )
    out = sessions.select(*keys).join(worst, list(keys), "left")
    level = F.coalesce("_rank", F.lit(0))
    deciding = F.filter(
        "_all", lambda x: F.when(level >= 3, x["r"] >= 3).otherwise((level == 2) & (x["r"] == 2))
    )
    return out.select(
        *keys, disposition_from_rank(level).alias("disposition"),
        F.coalesce(F.transform(deciding, lambda x: x["finding_id"]), F.array().cast("array<string>")).alias("reasons"),
    )


def spans_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column, Column]:
    start, end = F.greatest(s1, s2), F.least(e1, e2)
    known = s1.isNotNull() & s2.isNotNull() & e1.isNotNull() & e2.isNotNull() & (end > start)
    return F.when(known, start), F.when(known, end), F.when(known, (end - start) / F.lit(1e6)).otherwise(F.lit(0.0))


def paired(sessions: DataFrame, policy: QualityPolicy, pair: str = "attempt_id") -> DataFrame:
    """Both sessions of a pair on one row: overlaps, coverage share, findings and verdict.

    ``sessions`` carries the coverage columns, ``disposition`` and ``first_frame_us``.
    """
    fields = ["session_id", "disposition", "first_frame_us", "first_market_us", "last_market_us", "first_quote_us", "last_quote_us", "stale_interval_count"]
    of = lambda v: F.max(F.when(F.col("venue") == v, F.struct(*fields)))
    rows = sessions.groupBy(pair).agg(
        of(VENUE_1).alias("a"), of(VENUE_2).alias("b"), F.max("duration_seconds").alias("requested_seconds")
    )
    market = spans_overlap(*[F.col(f"{s}.{c}") for s in "ab" for c in ("first_market_us", "last_market_us")])
    quote = spans_overlap(*[F.col(f"{s}.{c}") for s in "ab" for c in ("first_quote_us", "last_quote_us")])
    shaped = rows.select(
        pair, F.col("a.session_id").alias("session_1"), F.col("b.session_id").alias("session_2"),
        F.col("a.disposition").alias("disposition_1"), F.col("b.disposition").alias("disposition_2"),
        (F.abs(F.col("a.first_frame_us") - F.col("b.first_frame_us")) / F.lit(1e6)).alias("start_skew_seconds"),
        market[0].alias("market_overlap_start_us"), market[1].alias("market_overlap_end_us"),
        market[2].alias("market_overlap_seconds"), quote[2].alias("quote_overlap_seconds"),
        proportion(market[2], F.col("requested_seconds")).alias("coverage_share"),
        (F.coalesce("a.stale_interval_count", F.lit(0)) + F.coalesce("b.stale_interval_count", F.lit(0))).alias("stale_intervals"),
    )
    skewed = F.col("start_skew_seconds") > policy.maximum_start_skew_seconds
    short = F.col("market_overlap_seconds") < policy.minimum_overlap_seconds
    either = lambda v: (F.col("disposition_1") == v) | (F.col("disposition_2") == v)
    rejected = either("REJECTED") | short
    held = either("QUARANTINED") | F.coalesce(skewed, F.lit(False))
    said = lambda *texts: F.filter(F.array(*texts), lambda x: x.isNotNull())
    of_session = lambda v: (
        F.when(F.col("disposition_1") == v, f"Coinbase session {v.lower()}"),
        F.when(F.col("disposition_2") == v, f"Kraken session {v.lower()}"),
    )
    return shaped.withColumn(
        "disposition", F.when(rejected, "REJECTED").when(held, "QUARANTINED").otherwise("ACCEPTED")
    ).withColumn(
        "reasons",
        F.when(rejected, said(*of_session("REJECTED"), F.when(short, "PAIR_OVERLAP_TOO_SHORT")))
        .when(held, said(*of_session("QUARANTINED"), F.when(skewed, "PAIR_START_SKEW_EXCEEDED")))
        .otherwise(F.array().cast("array<string>")),
    )


def aggregate_quality(sessions: DataFrame) -> DataFrame:
    """Totals over sessions and verdict counts."""
    verdict = lambda v: F.count_if(F.col("disposition") == v)
    return sessions.agg(
        F.count(F.lit(1)).alias("session_count"), verdict("ACCEPTED").alias("accepted_count"),
        verdict("QUARANTINED").alias("quarantined_count"), verdict("REJECTED").alias("rejected_count"),
        F.sum("duration_seconds").alias("total_duration_seconds"), F.sum("frames").alias("total_frames"),
        F.sum("archive_bytes").alias("total_raw_bytes"), F.sum("trades").alias("total_trades"),
        F.sum("quotes").alias("total_quotes"),
    )


def venue_event_rates(sessions: DataFrame) -> DataFrame:
    """Mean over sessions of trades plus quotes per second, by venue."""
    return sessions.groupBy("venue").agg(F.avg(F.col("trades_per_second") + F.col("quotes_per_second")).alias("event_rate"))


def archive_check(frames: DataFrame, shards: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per session: record index contiguous from 0 across shards, shard counts and bytes equal to the manifest's.

    ``shards`` has one row per session and shard with ``record_count`` and ``byte_size``.
    """
    placed, track = sliced(frames, keys, ["record_index"], "record_index")
    linked = carry(placed, track, before={"_p": F.col("record_index")})
    expected = F.coalesce(F.col("_p") + 1, F.lit(0))
    index = linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records_checked"), F.count_if(F.col("record_index") != expected).alias("index_mismatches")
    )
    actual = frames.groupBy(*keys, "shard").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("raw_frame_byte_length").alias("_b")
    )
    compared = shards.join(actual, [*keys, "shard"], "full").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shards_checked"), F.count_if(F.col("_n").isNull()).alias("missing_shards"),
        F.count_if(F.col("record_count").isNull()).alias("unlisted_shards"),
        F.count_if(F.col("_n") != F.col("record_count")).alias("count_mismatches"),
        F.count_if(F.col("_b") != F.col("byte_size")).alias("size_mismatches"),
    )
    out = index.join(compared, list(keys), "full")
    faults = ["index_mismatches", "missing_shards", "unlisted_shards", "count_mismatches", "size_mismatches"]
    clean = F.lit(True)
    for f in faults:
        clean = clean & (F.coalesce(F.col(f), F.lit(1)) == 0)
    return out.withColumn("archive_valid", clean)
