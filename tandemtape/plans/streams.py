"""Streaming queries drained to the end, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemtape.operators import parsing
from tandemtape.plans.frames import MARKET, PARSE, _PATH, _product_sql, _text_of, _units_of, archive_root, frames_of, sessions
from tandemtape.plans.registry import query, scratch, using
from tandemtape.streaming import streams

_LATENESS: dict[str, str] = {}


def _lateness(spark, folder):
    """Out-of-order span of the archive, measured once."""
    root = archive_root(spark, folder)
    if root not in _LATENESS:
        _LATENESS[root] = streams.replay_lateness(spark, root)
    return _LATENESS[root]


def _frames(spark, folder, marks=None):
    return streams.read_stream(spark, archive_root(spark, folder), marks=marks)


def _drained(spark, folder, build):
    """The final rows of ``build(frames)`` over the whole archive: all shards, then the mark that seals them."""
    marks, root, checkpoint = scratch(spark, "marks"), scratch(spark, "stream-table"), scratch(spark, "stream")
    streams.mark(spark, marks, streams.OPEN)
    for seal in (False, True):
        if seal:
            streams.mark(spark, marks)
        rows = build(_frames(spark, folder, marks))
        streams.finished(streams.append_table(rows, root, checkpoint))
    return spark.read.schema(rows.schema).parquet(root)


@query("stream_minute_counts", using("base framed archive", """
  SELECT session_id, receipt_us // 60000000 * 60000000 AS window_start, count(*) AS frames, sum(length(raw_frame)) AS bytes FROM archive GROUP BY 1, 2"""))
def stream_minute_counts(spark, folder):
    out = _drained(spark, folder, lambda frames: streams.minute_counts(frames, _lateness(spark, folder)))
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query("stream_outcome_counters", using(PARSE, """
  SELECT venue, receipt_us // 60000000 * 60000000 AS window_start, outcome, count(*) AS frames FROM outcome GROUP BY 1, 2, 3"""))
def stream_outcome_counters(spark, folder):
    out = _drained(spark, folder, lambda frames: streams.outcome_counters(frames, _lateness(spark, folder)))
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query("stream_quiet_periods", using("base framed archive", """
  SELECT session_id, min(receipt_us) AS active_from, max(receipt_us) AS last_frame, count(*) AS frames FROM (
    SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY receipt_us, record_index) AS island FROM (
      SELECT *, CASE WHEN receipt_us - lag(receipt_us) OVER (PARTITION BY session_id ORDER BY receipt_us, record_index) < 600000000 THEN 0 ELSE 1 END AS new FROM archive)) GROUP BY session_id, island"""))
def stream_quiet_periods(spark, folder):
    out = _drained(spark, folder, lambda frames: streams.quiet_periods(frames, 600, _lateness(spark, folder)))
    return out.select("session_id", F.unix_micros("active_from").alias("active_from"), F.unix_micros("last_frame").alias("last_frame"), "frames")


#: Copies are dropped as long as the hash is in state; the batch counts copies of a whole session, which lasts up to a week.
REPEATS_WITHIN = "14 days"


@query("stream_without_repeats", using(PARSE, "SELECT session_id, count(DISTINCT frame_hash) AS frames FROM outcome GROUP BY 1"))
def stream_without_repeats(spark, folder):
    kept = _drained(spark, folder, lambda frames: streams.without_repeats(frames, REPEATS_WITHIN).select("session_id", "frame_hash"))
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"))


@query("stream_latest_quotes", using(MARKET, """
  SELECT venue, ts_us, CAST(bid AS DOUBLE) AS bid_price, CAST(ask AS DOUBLE) AS ask_price FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY ts_us DESC, record_index DESC, child_index DESC) AS place FROM market WHERE kind = 'quote') WHERE place = 1"""))
def stream_latest_quotes(spark, folder):
    quotes = parsing.market_records(parsing.classify(_frames(spark, folder)), "quote").withColumn("ts_us", F.unix_micros("event_ts"))
    root = scratch(spark, "latest")
    streams.finished(streams.write_versions(streams.latest_quotes(quotes), root, scratch(spark, "stream")))
    out = streams.current(spark, root, ["venue"])
    return out.select("venue", "ts_us", F.col("quote.bid_price").cast("double").alias("bid_price"), F.col("quote.ask_price").cast("double").alias("ask_price"))


@query("stream_normalized_tables", using(MARKET, f"""
  SELECT kind, record_index, child_index, session_id, attempt_id AS campaign_attempt_id,
    sha256(concat('["1.0.0","', ds, '","', ds, '","', venue, '","', session_id, '","', {_PATH}, '",', record_index, ',"',
           CASE WHEN kind = 'trade' THEN 'trade' ELSE 'top_of_book' END, '",', child_index, ']')) AS normalized_event_id,
    CASE WHEN kind = 'trade' THEN {_text_of('notional_u')} ELSE {_text_of('spread_u')} END AS value, NULL AS outcome
  FROM (SELECT *, concat('validated-', attempt_id) AS ds, {_units_of('ask')} - {_units_of('bid')} AS spread_u, {_product_sql('price_u', 'quantity_u')} AS notional_u
        FROM (SELECT *, {_units_of('price')} AS price_u, {_units_of('quantity')} AS quantity_u FROM market))
  UNION ALL
  SELECT 'outcome', record_index, NULL, session_id, attempt_id, NULL, concat(trade_rows, '/', quote_rows), outcome FROM outcome"""))
def stream_normalized_tables(spark, folder):
    """All rows of the three tables that the stream wrote."""
    root = scratch(spark, "normalized")
    frames = frames_of(_frames(spark, folder))
    streams.finished(streams.normalize_stream(frames, sessions(spark, folder), root, scratch(spark, "stream")))
    none = lambda kind: F.lit(None).cast(kind)

    def events(table, kind, value):
        rows = streams.committed(spark, root, table)
        return rows.select(
            F.lit(kind).alias("kind"), F.col("source_record_index").alias("record_index"), F.col("normalized_child_index").alias("child_index"), "session_id",
            "campaign_attempt_id", "normalized_event_id", F.col(value).cast("string").alias("value"), none("string").alias("outcome"),
        )

    ends = streams.committed(spark, root, "raw_record_outcomes").select(
        F.lit("outcome"), "source_record_index", none("int"), "session_id", "campaign_attempt_id", none("string"),
        F.concat_ws("/", "normalized_trade_row_count", "normalized_bbo_row_count"), "normalization_outcome",
    )
    return events("trades", "trade", "notional").unionAll(events("top_of_book", "quote", "spread")).unionAll(ends)
