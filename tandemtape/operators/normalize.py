"""Classified frames to the exact-decimal trade, quote and outcome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape import schemas as S
from tandemtape.functions import numbers as N
from tandemtape.operators import identity, parsing
from tandemtape.session import cut


def prepare(archive: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames with duplicate marks, parse result and session lineage; input of the three table builders.

    ``archive`` needs the archive columns, ``session_id`` and ``shard_path``; ``sessions`` is one row per session.
    """
    hashed = archive.withColumn("frame_hash", identity.frame_hash(F.col("venue"), F.col("frame_type"), F.col("raw_frame")))
    # Numbering copies reads its input twice and shuffles it, so frames are scanned, hashed and parsed before, once.
    return _of_sessions(identity.numbered_copies(cut(_results(hashed))), sessions)


def parsed(marked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Marked frames with parse result and session lineage."""
    return _of_sessions(_results(marked), sessions)


def _results(frames: DataFrame) -> DataFrame:
    return parsing.classify(frames).drop("payload", "raw_frame")


def _of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    known = [c for c in S.FROM_METADATA + ["source_shard_sha256"] if c in sessions.columns]
    return rows.join(sessions.select("session_id", *known), "session_id", "left")


def _lineage(df: DataFrame) -> dict[str, Column]:
    receipt = F.col("local_receipt_ts")
    shard = F.col("shard_path")
    given = {c: F.col(c) if c in df.columns else F.lit(None) for c in S.FROM_METADATA}
    shard_sha = F.col("source_shard_sha256") if "source_shard_sha256" in df.columns else F.lit(None)
    version = F.when(F.col("venue") == S.VENUE_1, S.PARSER_VERSIONS[S.VENUE_1]).otherwise(S.PARSER_VERSIONS[S.VENUE_2])
    return given | {
        "source_shard_relative_path": shard,
        "source_raw_shard_relative_path": shard,
        "source_shard_sha256": shard_sha,
        "source_raw_shard_sha256": shard_sha,
        "venue": F.col("venue"),
        "canonical_instrument": F.col("canonical_instrument"),
        "venue_symbol": F.col("venue_symbol"),
        "session_id": F.col("session_id"),
        "venue_session_id": F.col("session_id"),
        "connection_epoch": F.lit(0),
        "source_raw_record_index": F.col("record_index"),
        "source_record_index": F.col("record_index"),
        "source_raw_frame_sha256": F.col("frame_hash"),
        "local_receipt_ts": receipt,
        "receipt_timestamp_utc": receipt,
        "original_receipt_timestamp": iso(receipt),
        "is_raw_frame_duplicate": F.col("duplicate_count") > 1,
        "duplicate_classification": F.col("duplicate_class"),
        "raw_frame_duplicate_count": F.col("duplicate_count"),
        "raw_frame_duplicate_occurrence_index": F.col("occurrence_index"),
        "parser_version": version,
    }


def iso(ts: Column) -> Column:
    """Seconds-precision ISO text with the microseconds only when there are any."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.when(whole, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def _event(df: DataFrame, kind: str, time_meaning: str) -> dict[str, Column]:
    lineage = _lineage(df)
    dataset = F.coalesce(
        lineage["dataset_snapshot_id"], lineage["validated_campaign_manifest_id"], lineage["validated_dataset_manifest_id"]
    )
    manifest = F.coalesce(lineage["validated_campaign_manifest_id"], lineage["validated_dataset_manifest_id"])
    place = (F.col("venue"), F.col("session_id"), F.col("shard_path"), F.col("record_index"))
    child = F.col("child_index")
    return lineage | {
        "normalized_event_id": identity.event_id(
            lineage["normalized_schema_version"], dataset, manifest, *place, kind, child
        ),
        "source_event_id": identity.source_event_id(*place, kind, child),
        "source_channel": F.col("channel"),
        "source_message_type": F.col("message"),
        "normalized_child_index": child,
        "exchange_ts": F.col("event_ts"),
        "exchange_timestamp_utc": F.col("event_ts"),
        "original_exchange_timestamp": iso(F.col("event_ts")),
        "has_exchange_timestamp": F.lit(True),
        "exchange_timestamp_semantics": F.lit(time_meaning),
        "receipt_timestamp_semantics": F.lit("local_collector_receipt_time"),
        "source_sequence": F.col("source_sequence"),
        "source_checksum": F.lit(None),
        "normalization_warning_codes": F.array().cast("array<string>"),
    }


def _shaped(df: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    return df.select(*[values.get(c, F.lit(None)).cast(S.column_type(c)).alias(c) for c in columns])


def trades(prepared: DataFrame) -> DataFrame:
    rows = parsing.market_records(prepared, "trade")
    rows = parsing.settled(rows.withColumns({c: N.stored(F.col(c)) for c in ("price", "quantity")}), "price", "quantity")
    side, trade_id = F.col("aggressor_side"), F.col("trade_id")
    return _shaped(
        rows, S.TRADE_COLUMNS,
        _event(rows, "trade", "venue_event_time") | {
            "trade_id": trade_id, "venue_trade_id": trade_id, "source_trade_id": trade_id,
            "price": F.col("price"), "quantity": F.col("quantity"),
            "notional": N.product(F.col("price"), F.col("quantity")),
            "side": side, "normalized_side": side,
            "side_semantics": F.lit("normalized_aggressor_side_from_existing_parser"),
            "aggressor_side_interpretation_status": F.lit("PARSER_DERIVED"),
        },
    )


def quote_measures(rows: DataFrame, bid: str = "bid_price", bid_size: str = "bid_size", ask: str = "ask_price", ask_size: str = "ask_size") -> DataFrame:
    """Add the derived quote columns, step by step; ratios are null where their base is zero."""
    b, bs, a, az = (F.col(c) for c in (bid, bid_size, ask, ask_size))
    rows = rows.withColumns({
        "midprice": N.midpoint(b, a), "spread": N.difference(a, b), "quoted_depth": N.total(bs, az), "_lean": N.difference(bs, az),
        "locked_market_indicator": a == b, "crossed_market_indicator": a < b,
    })
    rows = parsing.settled(rows, "midprice", "spread", "quoted_depth", "_lean")
    rows = rows.withColumns({"relative_spread": N.ratio(F.col("spread"), F.col("midprice")), "bid_ask_imbalance": N.ratio(F.col("_lean"), F.col("quoted_depth"))})
    rows = parsing.settled(rows, "relative_spread", "bid_ask_imbalance")
    return rows.withColumn("spread_basis_points", N.times(F.col("relative_spread"), 4)).drop("_lean")


DERIVED = ["midprice", "spread", "relative_spread", "spread_basis_points", "quoted_depth", "bid_ask_imbalance", "locked_market_indicator", "crossed_market_indicator"]


def quotes(prepared: DataFrame) -> DataFrame:
    rows = parsing.market_records(prepared, "quote")
    prices = ("bid_price", "bid_size", "ask_price", "ask_size")
    rows = quote_measures(parsing.settled(rows.withColumns({c: N.stored(F.col(c)) for c in prices}), *prices))
    return _shaped(
        rows, S.QUOTE_COLUMNS,
        _event(rows, "top_of_book", "venue_quote_time")
        | {c: F.col(c) for c in (*prices, *DERIVED)}
        | {"quote_change_indicator": F.lit("OBSERVED")},
    )


def outcomes(prepared: DataFrame) -> DataFrame:
    """One row per raw frame: what became of it."""
    kind = F.col("result_kind")
    failed = kind.isin("undecodable", "not_object", "invalid")
    trades_in = F.when(kind == "trade", F.size("records")).otherwise(0)
    quotes_in = F.when(kind == "quote", F.size("records")).otherwise(0)
    return _shaped(
        prepared, S.OUTCOME_COLUMNS,
        _lineage(prepared) | {
            "frame_type": F.col("frame_type"),
            "source_message_type": F.col("message"),
            "source_channel": F.col("channel"),
            "normalization_outcome": parsing.outcome(kind, F.col("records")),
            "normalized_trade_row_count": trades_in,
            "normalized_bbo_row_count": quotes_in,
            "normalized_total_row_count": trades_in + quotes_in,
            "parse_status": F.when(failed, "ERROR").otherwise("OK"),
            "parse_error_type": F.when(kind == "undecodable", "JSONDecodeError")
            .when(kind == "not_object", "TypeError").when(kind == "invalid", "MessageParseError"),
            "parse_error_message": F.substring(
                F.when(kind == "undecodable", "frame is not one JSON value")
                .when(kind == "not_object", "payload is not a JSON object")
                .when(kind == "invalid", F.concat(F.lit("missing or invalid field in message "), F.coalesce("message", F.lit("?")))),
                1, parsing.ERROR_TEXT,
            ),
            "unsupported_reason": F.when(kind == "unsupported", "message outside the supported channels or instrument")
            .when(kind == "error", F.col("detail")),
        },
    )


def tables(archive: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The three tables from one parse: the prepared frames are cut, as each table reads them."""
    ready = cut(prepare(archive, sessions))
    return {"trades": trades(ready), "top_of_book": quotes(ready), "raw_record_outcomes": outcomes(ready)}


def event_stream(trade_rows: DataFrame, quote_rows: DataFrame) -> DataFrame:
    """Trades and quotes as one stream, missing columns null."""
    return trade_rows.withColumn("event_type", F.lit("trade")).unionByName(
        quote_rows.withColumn("event_type", F.lit("top_of_book")), allowMissingColumns=True
    )


def reconciliation(trade_rows: DataFrame, quote_rows: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """One verdict row: outcome counts add up to the table rows and no event id repeats."""
    none = F.lit(None).cast("bigint")
    counted = outcome_rows.agg(
        F.sum("normalized_trade_row_count").alias("expected_trades"),
        F.sum("normalized_bbo_row_count").alias("expected_quotes"),
    ).select("expected_trades", "expected_quotes", *[none.alias(c) for c in ("trade_rows", "quote_rows", "repeated_event_ids")])
    ids = trade_rows.select("normalized_event_id", F.lit(1).alias("t"), F.lit(0).alias("q")).unionAll(
        quote_rows.select("normalized_event_id", F.lit(0), F.lit(1))
    ).groupBy("normalized_event_id").agg(F.sum("t").alias("t"), F.sum("q").alias("q"))
    actual = ids.agg(
        F.sum("t").alias("trade_rows"), F.sum("q").alias("quote_rows"),
        F.count_if(F.col("t") + F.col("q") > 1).alias("repeated_event_ids"),
    ).select(none.alias("expected_trades"), none.alias("expected_quotes"), "trade_rows", "quote_rows", "repeated_event_ids")
    merged = counted.unionAll(actual).agg(*[F.max(c).alias(c) for c in counted.columns])
    return merged.withColumn(
        "reconciliation_status",
        F.when(
            (F.col("expected_trades") == F.col("trade_rows")) & (F.col("expected_quotes") == F.col("quote_rows"))
            & (F.col("repeated_event_ids") == 0), "PASSED",
        ).otherwise("FAILED"),
    )
