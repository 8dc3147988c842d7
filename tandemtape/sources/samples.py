"""Adapters that read the test tables as market data.

``events`` stands for one stream of ticks: two of its event types are venue 1, the rest venue 2, and a calendar week is
one attempt.  The same SQL text builds the archived frames here and in the checks, so both sides start from equal bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtape.operators.ordered import carry, sliced
from tandemtape.operators.parsing import settled

# Microseconds since 1970, the week's Monday as the attempt, venue and the integer inside props.
_BASE = """
  SELECT event_id AS record_index, {us} AS ts_us, event_type, value, user_id,
         CAST({k} AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents,
         CASE WHEN event_type IN ('click', 'view') THEN 'coinbase' ELSE 'kraken' END AS venue,
         concat('attempt-', {monday}) AS attempt_id, {iso} AS iso
  FROM events
"""
SPARK_TOKENS = {
    "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
    "k": "get_json_object(props, '$.k')",
    "monday": "date_format(date_trunc('WEEK', ts), 'yyyy-MM-dd')",
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    "b64": "replace(base64(encode(frame_text, 'UTF-8')), '\\r\\n', '')",
}
DUCK_TOKENS = {
    "us": "epoch_us(ts)",
    "k": "json_extract_string(props, '$.k')",
    "monday": "strftime(date_trunc('week', ts), '%Y-%m-%d')",
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
    "b64": "to_base64(encode(frame_text))",
}

_TICKS = """
  SELECT record_index, ts_us, ts_us + (k - 20) * 1000000 AS receipt_us, attempt_id, venue,
         concat(attempt_id, '-', venue) AS session_id, k, cents,
         100 + value AS price, CAST(k + 1 AS DOUBLE) AS quantity,
         100 + value - 0.01 * (1 + k % 5) AS bid_price, 100 + value + 0.01 * (1 + k % 3) AS ask_price,
         CAST(k % 11 AS DOUBLE) AS bid_size, CAST(1 + k % 7 AS DOUBLE) AS ask_size
  FROM base
"""

# Frame texts of both venues; every planted fault is a rule on event_id, so it scales with the table.
_NUM = "CAST(CAST(100 + value AS DECIMAL(18,2)) AS STRING)"
_QTY = "CAST(CAST((k + 1) / 8.0 AS DECIMAL(18,3)) AS STRING)"
_BID = "CAST(CAST(100 + value - 0.01 * (k % 5) AS DECIMAL(18,2)) AS STRING)"
_ASK = "CAST(CAST(100 + value + 0.01 * (k % 4) - 0.01 AS DECIMAL(18,2)) AS STRING)"
_SYM2 = """concat('{"symbol":"', CASE WHEN event_id % 73 = 7 THEN 'ETH/USD' ELSE 'BTC/USD' END, '",')"""
_TRADE2 = (
    f"""concat({_SYM2}, '"side":"', CASE WHEN k % 3 = 0 THEN 'buy' WHEN k % 3 = 1 THEN 'sell' ELSE 'none' END,
    '","qty":', CASE WHEN event_id % 61 = 9 THEN '0.000' ELSE {_QTY} END, ',"price":', {_NUM},
    CASE WHEN event_id % 71 = 4 THEN '' ELSE concat(',"trade_id":', CAST(floor(event_id / 4) AS BIGINT)) END,
    ',"timestamp":"', CASE WHEN event_id % 67 = 6 THEN '2024-01-01T00:00:00' ELSE iso END, '"}}')"""
)
_QUOTE2 = (
    f"""concat({_SYM2}, '"bid":', {_BID}, ',"bid_qty":', CAST(k % 11 AS STRING), ',"ask":', {_ASK}, ',"ask_qty":',
    CASE WHEN event_id % 61 = 9 THEN '-1' ELSE CAST(1 + k % 7 AS STRING) END, ',"timestamp":"', iso, '"}}')"""
)
_FRAMES = (
    """
  SELECT *, CASE
    WHEN event_id % 97 = 5 THEN '{"type":"match","trade_id":'
    WHEN event_id % 101 = 1 THEN '[1,2]'
    WHEN venue = 'coinbase' THEN CASE
      WHEN event_id % 19 = 3 THEN concat('{"type":"heartbeat","sequence":', event_id, ',"last_trade_id":',
           CAST(floor(event_id / 2) AS BIGINT), ',"product_id":"BTC-USD","time":"', iso, '"}')
      WHEN event_id % 83 = 2 THEN '{"type":"subscriptions","channels":[{"name":"matches","product_ids":["BTC-USD"]}]}'
      WHEN event_id % 79 = 1 THEN '{"type":"error","message":"rate limited"}'
      WHEN event_id % 59 = 8 THEN '{"type":"status","products":[{"id":"BTC-USD","status":"online"}]}'
      WHEN event_type = 'click' THEN concat(
           '{"type":"', CASE WHEN event_id % 2 = 0 THEN 'match' ELSE 'last_match' END, '","trade_id":',
           CAST(floor(event_id / 2) AS BIGINT), ',"sequence":', event_id - CASE WHEN k % 17 = 0 THEN 400 ELSE 0 END,
           ',"time":"', CASE WHEN event_id % 67 = 6 THEN 'not-a-timestamp' ELSE iso END,
           '","product_id":"', CASE WHEN event_id % 73 = 7 THEN 'ETH-USD' ELSE 'BTC-USD' END,
           '","side":"', CASE WHEN k % 3 = 0 THEN 'buy' WHEN k % 3 = 1 THEN 'sell' ELSE 'none' END, '"',
           CASE WHEN event_id % 71 = 4 THEN '' ELSE concat(',"size":"', QTY, '"') END,
           ',"price":"', CASE WHEN event_id % 61 = 9 THEN '-1' ELSE NUM END, '"}')
      ELSE concat('{"type":"ticker","sequence":', event_id, ',"product_id":"',
           CASE WHEN event_id % 73 = 7 THEN 'ETH-USD' ELSE 'BTC-USD' END, '","best_bid":"',
           CASE WHEN event_id % 71 = 4 THEN 'not-a-price' ELSE BID END, '","best_bid_size":"', k % 11,
           '","best_ask":"', ASK, '","best_ask_size":"', CASE WHEN event_id % 61 = 9 THEN -1 ELSE 1 + k % 7 END,
           '","time":"', iso, '","trade_id":', CAST(floor(event_id / 2) AS BIGINT), '}')
      END
    WHEN event_id % 17 = 4 THEN '{"channel":"heartbeat"}'
    WHEN event_id % 83 = 2 THEN '{"channel":"status","type":"update","data":[{"system":"online"}]}'
    WHEN event_id % 79 = 1 THEN concat('{"method":"subscribe","result":{"channel":"trade","symbol":"BTC/USD"},',
         '"success":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false,"error":"denied"' END, '}')
    WHEN event_id % 59 = 8 THEN '{"channel":"instruments","type":"snapshot","data":[]}'
    WHEN event_id % 53 = 3 THEN '{"channel":"trade","type":"update","data":[]}'
    WHEN event_type = 'signup' THEN concat('{"channel":"ticker","type":"',
         CASE WHEN event_id % 7 = 0 THEN 'snapshot' ELSE 'update' END, '","data":[', QUOTE2,
         CASE WHEN event_id % 29 = 11 THEN concat(',', QUOTE2) ELSE '' END, ']}')
    ELSE concat('{"channel":"trade","type":"', CASE WHEN event_id % 7 = 0 THEN 'snapshot' ELSE 'update' END,
         '","data":[', CASE WHEN event_id % 13 = 5
           THEN concat('{"symbol":"ETH/USD","side":"buy","qty":1,"price":1,"trade_id":1,"timestamp":"', iso, '"},')
           ELSE '' END, TRADE2, CASE WHEN event_type = 'purchase' THEN concat(',', TRADE2) ELSE '' END, ']}')
    END AS frame_text
  FROM (SELECT *, record_index AS event_id FROM base)
"""
    .replace("QUOTE2", _QUOTE2).replace("TRADE2", _TRADE2).replace("QTY", _QTY).replace("NUM", _NUM)
    .replace("BID", _BID).replace("ASK", _ASK).replace("}}'", "}'")
)
_ARCHIVE = """
  SELECT record_index, concat(attempt_id, '-', venue) AS session_id, venue, attempt_id,
         ts_us + (k - 20) * 1000000 AS receipt_us,
         CASE WHEN record_index % 31 = 0 THEN 'binary' ELSE 'text' END AS frame_type,
         CASE WHEN record_index % 31 = 0 THEN {b64} ELSE frame_text END AS raw_frame
  FROM framed
"""


def base_sql(tokens: dict[str, str]) -> str:
    return _BASE.format(**tokens)


def ticks_sql() -> str:
    return _TICKS


def frames_sql() -> str:
    return _FRAMES


def archive_sql(tokens: dict[str, str]) -> str:
    return _ARCHIVE.format(**tokens)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(base_sql(SPARK_TOKENS).replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per tick with both a trade and a quote reading of it."""
    return spark.sql(ticks_sql().replace("FROM base", "FROM {base}"), base=base(spark, folder))


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """The events as archived raw frames of both venues, planted faults included."""
    framed = spark.sql(
        frames_sql().replace("{", "{{").replace("}", "}}").replace("FROM base", "FROM {base}"), base=base(spark, folder)
    )
    framed = settled(framed, "frame_text")
    out = spark.sql(archive_sql(SPARK_TOKENS).replace("FROM framed", "FROM {framed}"), framed=framed)
    return out.select(
        F.lit("1.0").alias("archive_schema_version"), "record_index",
        F.col("session_id").alias("collector_session_id"), "venue", F.lit("BTC-USD").alias("canonical_instrument"),
        F.when(F.col("venue") == "coinbase", "BTC-USD").otherwise("BTC/USD").alias("venue_symbol"),
        F.timestamp_micros("receipt_us").alias("local_receipt_ts"), "frame_type",
        F.when(F.col("frame_type") == "binary", "base64").otherwise("utf-8").alias("frame_encoding"), "raw_frame",
        F.octet_length("raw_frame").cast("bigint").alias("raw_frame_byte_length"),
        F.lit(None).cast("string").alias("message_type"), F.lit(None).cast("string").alias("source_channel"),
        F.lit(None).cast("timestamp").alias("exchange_ts"), F.col("attempt_id").alias("campaign_attempt_id"),
        F.floor(F.col("record_index") / 5000).alias("shard"),
    )


_TREND = """
  SELECT record_index, ts_us, attempt_id, venue, 100 * exp((running - nth * whole / n) / 100.0 / 20000.0 + (k - 50) * 1e-5) AS price
  FROM summed
"""


def trend_sql() -> str:
    return _TREND


def trend(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes whose log price follows one common walk per attempt plus noise; both venues observe it."""
    placed, track = sliced(base(spark, folder), ["attempt_id"], ["record_index"], "record_index")
    one = F.lit(1).cast("bigint")
    summed = carry(placed, track, sums={"running": F.col("cents"), "nth": one}, totals={"whole": F.col("cents"), "n": one})
    rows = spark.sql(trend_sql().replace("FROM summed", "FROM {summed}"), summed=summed)
    return rows.withColumns({"bid_price": F.col("price"), "ask_price": F.col("price")})
