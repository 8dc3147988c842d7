"""Explicit schemas and the fixed values that appear in stored data."""

from __future__ import annotations

from pyspark.sql import types as T

# Venue names, instrument symbols and version tags found in archived and normalized data.
VENUE_1 = "coinbase"
VENUE_2 = "kraken"
INSTRUMENT = "BTC-USD"
SYMBOLS = {VENUE_1: "BTC-USD", VENUE_2: "BTC/USD"}
PARSER_VERSIONS = {VENUE_1: "coinbase:0.1.0", VENUE_2: "kraken:0.1.0"}

STORED_PRECISION = 38
STORED_SCALE = 18
STORED = f"decimal({STORED_PRECISION},{STORED_SCALE})"

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    STORED: T.DecimalType(STORED_PRECISION, STORED_SCALE),
}


def _schema(columns: dict[str, str]) -> T.StructType:
    """Built from type names without a session, so importing this module needs none."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# One archived frame (one JSON line of a shard).
ARCHIVE = _schema(
    {
        "archive_schema_version": "string", "record_index": "bigint", "collector_session_id": "string",
        "venue": "string", "canonical_instrument": "string", "venue_symbol": "string",
        "local_receipt_ts": "timestamp", "frame_type": "string", "frame_encoding": "string", "raw_frame": "string",
        "raw_frame_byte_length": "bigint", "message_type": "string", "source_channel": "string",
        "exchange_ts": "timestamp",
    }
)

# Stored column names of the normalized tables, grouped by what supplies them.
FROM_METADATA = [  # one row per session
    "dataset_snapshot_id", "source_catalog_id", "source_catalog_hash", "normalized_schema_version",
    "normalization_config_hash", "campaign_id", "campaign_role", "slot_id", "slot_type", "campaign_attempt_id",
    "time_bucket", "validated_campaign_manifest_id", "validated_campaign_manifest_sha256",
    "validated_dataset_manifest_id", "validated_dataset_manifest_sha256", "paired_collection_id",
    "source_session_manifest_sha256", "source_quality_report_sha256", "paired_quality_report_sha256",
    "collection_runtime_git_commit", "quality_code_git_commit", "quality_policy_version",
]
FROM_SHARD = [
    "source_shard_relative_path", "source_raw_shard_relative_path", "source_shard_sha256", "source_raw_shard_sha256",
]
FROM_FRAME = [
    "venue", "canonical_instrument", "venue_symbol", "session_id", "venue_session_id", "connection_epoch",
    "source_raw_record_index", "source_record_index", "source_raw_frame_sha256", "local_receipt_ts",
    "receipt_timestamp_utc", "original_receipt_timestamp", "is_raw_frame_duplicate", "duplicate_classification",
    "raw_frame_duplicate_count", "raw_frame_duplicate_occurrence_index", "parser_version",
]
LINEAGE_COLUMNS = FROM_METADATA + FROM_SHARD + FROM_FRAME
FROM_EVENT = [
    "normalized_event_id", "source_event_id", "source_channel", "source_message_type", "normalized_child_index",
    "exchange_ts", "exchange_timestamp_utc", "original_exchange_timestamp", "has_exchange_timestamp",
    "exchange_timestamp_semantics", "receipt_timestamp_semantics", "source_sequence", "source_checksum",
    "normalization_warning_codes",
]
TRADE_ONLY = [
    "trade_id", "venue_trade_id", "price", "quantity", "notional", "side", "reported_side", "normalized_side",
    "side_semantics", "aggressor_side_interpretation_status", "source_trade_id",
]
QUOTE_ONLY = [
    "bid_price", "bid_size", "ask_price", "ask_size", "midprice", "spread", "relative_spread", "spread_basis_points",
    "quoted_depth", "bid_ask_imbalance", "locked_market_indicator", "crossed_market_indicator",
    "quote_change_indicator",
]
OUTCOME_ONLY = [
    "frame_type", "source_message_type", "source_channel", "normalization_outcome", "normalized_trade_row_count",
    "normalized_bbo_row_count", "normalized_total_row_count", "parse_status", "parse_error_type",
    "parse_error_message", "unsupported_reason",
]
TRADE_COLUMNS = LINEAGE_COLUMNS + FROM_EVENT + TRADE_ONLY
QUOTE_COLUMNS = LINEAGE_COLUMNS + FROM_EVENT + QUOTE_ONLY
OUTCOME_COLUMNS = LINEAGE_COLUMNS + OUTCOME_ONLY

_TIMES = {"local_receipt_ts", "receipt_timestamp_utc", "exchange_ts", "exchange_timestamp_utc"}
_FLAGS = {
    "is_raw_frame_duplicate", "has_exchange_timestamp", "locked_market_indicator", "crossed_market_indicator",
}
_LONGS = {
    "source_raw_record_index", "source_record_index", "raw_frame_duplicate_count",
    "raw_frame_duplicate_occurrence_index", "normalized_trade_row_count", "normalized_bbo_row_count",
    "normalized_total_row_count",
}
_INTS = {"connection_epoch", "normalized_child_index"}
_DECIMALS = {
    "price", "quantity", "notional", "bid_price", "bid_size", "ask_price", "ask_size", "midprice", "spread",
    "relative_spread", "spread_basis_points", "quoted_depth", "bid_ask_imbalance",
}


def column_type(name: str) -> str:
    for names, kind in (
        (_TIMES, "timestamp"), (_FLAGS, "boolean"), (_LONGS, "bigint"), (_INTS, "int"), (_DECIMALS, STORED),
    ):
        if name in names:
            return kind
    return "array<string>" if name == "normalization_warning_codes" else "string"


def table_schema(columns: list[str]) -> T.StructType:
    return _schema({c: column_type(c) for c in columns})


TRADES = table_schema(TRADE_COLUMNS)
QUOTES = table_schema(QUOTE_COLUMNS)
OUTCOMES = table_schema(OUTCOME_COLUMNS)
