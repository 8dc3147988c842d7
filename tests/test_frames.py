"""Frame classification, exact decimals and identities on hand-made messages."""

from __future__ import annotations

import base64
import hashlib
import json
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tandemtape.functions import numbers as N
from tandemtape.operators import identity, inference, normalize, parsing
from tandemtape.sources import archive as archive_source
from tandemtape.sources import tables
from tandemtape import schemas as S

MATCH = {"type": "match", "trade_id": 5, "sequence": 9, "time": "2026-07-30T21:00:00.123456Z", "product_id": "BTC-USD", "side": "sell", "size": "0.5", "price": "68000.2"}
TICKER = {"type": "ticker", "sequence": 1, "product_id": "BTC-USD", "best_bid": "10", "best_bid_size": "0", "best_ask": "11", "best_ask_size": "2", "time": "2026-07-30T21:00:00Z"}
TRADE = {"symbol": "BTC/USD", "side": "buy", "qty": 0.25, "price": 68000.2, "ord_type": "market", "trade_id": 7, "timestamp": "2026-07-30T21:00:00.1Z"}
QUOTE = {"symbol": "BTC/USD", "bid": 10.5, "bid_qty": 1, "ask": 10.5, "ask_qty": 2, "timestamp": "2026-07-30T21:00:00+00:00"}


def kr(channel, *records, type="update"):
    return {"channel": channel, "type": type, "data": list(records)}


CASES = [
    ("coinbase", MATCH, "NORMALIZED_TRADE"), ("coinbase", MATCH | {"type": "last_match"}, "NORMALIZED_TRADE"),
    ("coinbase", TICKER, "NORMALIZED_TOP_OF_BOOK"), ("coinbase", {"type": "heartbeat", "product_id": "BTC-USD"}, "HEARTBEAT"),
    ("coinbase", {"type": "subscriptions", "channels": []}, "SUBSCRIPTION_ACKNOWLEDGEMENT"),
    ("coinbase", {"type": "error", "message": "no"}, "EXCHANGE_ERROR"), ("coinbase", {"type": "error"}, "PARSE_ERROR"),
    ("coinbase", {"type": "status"}, "UNSUPPORTED_MESSAGE"), ("coinbase", TICKER | {"product_id": "ETH-USD"}, "UNSUPPORTED_MESSAGE"),
    ("coinbase", {k: v for k, v in MATCH.items() if k != "size"}, "PARSE_ERROR"), ("coinbase", TICKER | {"best_bid": "not-a-price"}, "PARSE_ERROR"),
    ("coinbase", MATCH | {"time": "not-a-timestamp"}, "PARSE_ERROR"), ("coinbase", MATCH | {"time": "2026-07-30T21:00:00"}, "PARSE_ERROR"),
    ("coinbase", MATCH | {"trade_id": True}, "PARSE_ERROR"), ("coinbase", MATCH | {"price": True}, "PARSE_ERROR"),
    ("coinbase", MATCH | {"price": "0"}, "PARSE_ERROR"), ("coinbase", TICKER | {"best_ask_size": "-1"}, "PARSE_ERROR"),
    ("coinbase", MATCH | {"sequence": "12ab"}, "NORMALIZED_TRADE"), ("coinbase", MATCH | {"sequence": 1.5}, "PARSE_ERROR"),
    ("coinbase", {"type": 5}, "PARSE_ERROR"), ("coinbase", [1], "PARSE_ERROR"), ("coinbase", {"type": "heartbeat", "product_id": "ETH-USD"}, "UNSUPPORTED_MESSAGE"),
    ("kraken", kr("trade", TRADE), "NORMALIZED_TRADE"), ("kraken", kr("trade", TRADE, TRADE, type="snapshot"), "NORMALIZED_MULTIPLE_TRADES"),
    ("kraken", kr("trade", TRADE | {"symbol": "ETH/USD"}, TRADE), "NORMALIZED_TRADE"), ("kraken", kr("ticker", QUOTE), "NORMALIZED_TOP_OF_BOOK"),
    ("kraken", kr("ticker", QUOTE, QUOTE), "NO_NORMALIZED_EVENT"), ("kraken", kr("trade"), "PARSE_ERROR"), ("kraken", kr("trade", 4), "PARSE_ERROR"),
    ("kraken", kr("trade", TRADE | {"symbol": "ETH/USD"}), "UNSUPPORTED_MESSAGE"), ("kraken", {"channel": "heartbeat"}, "HEARTBEAT"),
    ("kraken", {"channel": "status", "data": []}, "STATUS_MESSAGE"), ("kraken", {"channel": "instruments"}, "UNSUPPORTED_MESSAGE"),
    ("kraken", {"method": "subscribe", "result": {"channel": "trade", "symbol": "BTC/USD"}, "success": True}, "SUBSCRIPTION_ACKNOWLEDGEMENT"),
    ("kraken", {"method": "subscribe", "result": {"channel": "trade"}, "success": False, "error": "x"}, "EXCHANGE_ERROR"),
    ("kraken", {"method": "subscribe", "result": {"channel": "trade", "symbol": "ETH/USD"}}, "UNSUPPORTED_MESSAGE"),
    ("kraken", {"method": "subscribe"}, "PARSE_ERROR"), ("kraken", {"method": "error", "error": "bad"}, "EXCHANGE_ERROR"),
    ("kraken", kr("trade", {k: v for k, v in TRADE.items() if k != "qty"}), "PARSE_ERROR"), ("kraken", {}, "PARSE_ERROR"),
]


def frame_rows(spark):
    texts = [(v, json.dumps(p)) for v, p, _ in CASES] + [("coinbase", '{"type":'), ("coinbase", json.dumps(MATCH) + " x"), ("kraken", "")]
    rows = [
        (i, v, "text" if i % 2 else "binary", t if i % 2 else base64.b64encode(t.encode()).decode()) for i, (v, t) in enumerate(texts)
    ] + [(len(texts), "coinbase", "binary", base64.b64encode(b"\xff\xfe").decode())]
    df = spark.createDataFrame(rows, "record_index long, venue string, frame_type string, raw_frame string")
    return df.withColumns({
        "session_id": F.concat(F.lit("s-"), "venue"), "canonical_instrument": F.lit("BTC-USD"), "venue_symbol": F.lit("x"),
        "local_receipt_ts": F.timestamp_micros(F.col("record_index") * 1_000_000 + 5), "shard_path": F.lit("raw/part-00000.jsonl"),
    })


def test_outcome_codes(spark):
    got = parsing.classify(frame_rows(spark)).select("record_index", parsing.outcome(F.col("result_kind"), F.col("records")).alias("o")).collect()
    by = {r.record_index: r.o for r in got}
    expected = [o for _, _, o in CASES] + ["JSON_DECODE_ERROR"] * 4
    assert [by[i] for i in range(len(expected))] == expected


def test_tables_reconcile_and_keep_exact_values(spark):
    sessions = spark.createDataFrame(
        [("s-coinbase", "a-1", "1.0", "set"), ("s-kraken", "a-1", "1.0", "set")],
        "session_id string, campaign_attempt_id string, normalized_schema_version string, validated_dataset_manifest_id string",
    )
    t = normalize.tables(frame_rows(spark), sessions)
    assert t["trades"].columns == S.TRADE_COLUMNS and len(S.TRADE_COLUMNS) == 68
    assert t["top_of_book"].columns == S.QUOTE_COLUMNS and len(S.QUOTE_COLUMNS) == 70
    assert t["raw_record_outcomes"].columns == S.OUTCOME_COLUMNS and len(S.OUTCOME_COLUMNS) == 54
    assert normalize.reconciliation(*t.values()).collect()[0].reconciliation_status == "PASSED"
    trades = {(r.source_record_index, r.normalized_child_index): r for r in t["trades"].collect()}
    first = trades[(0, 0)]
    assert first.price == Decimal("68000.2") and first.notional == Decimal("34000.1") and first.side == "buy"
    # The child index counts records of our symbol only.
    assert (24, 0) in trades and (24, 1) not in trades
    text = json.dumps(["1.0", "set", "set", "coinbase", "s-coinbase", "raw/part-00000.jsonl", 0, "trade", 0], separators=(",", ":"))
    assert first.normalized_event_id == hashlib.sha256(text.encode()).hexdigest()
    quote = next(r for r in t["top_of_book"].collect() if r.source_record_index == 25)
    assert quote.locked_market_indicator and quote.bid_ask_imbalance == Decimal("-0.333333333333333333")


@pytest.mark.parametrize("a,b", [("2", "3"), ("-2", "3"), ("1", "8"), ("0.000000001", "99999999"), ("123456.789", "0.001"), ("5", "0"), ("-7", "-9"), ("1", "200000000"), ("99999999", "100000000"), ("0.999999999", "1.000000001")])
def test_ratio_is_exact_half_even(spark, a, b):
    got = spark.range(1).select(N.ratio(F.lit(a).cast("decimal(20,9)"), F.lit(b).cast("decimal(20,9)")).alias("r")).collect()[0].r
    with localcontext() as c:
        c.prec = 60
        expected = None if Decimal(b) == 0 else (Decimal(a) / Decimal(b)).quantize(Decimal("1e-18"), rounding=ROUND_HALF_EVEN)
    assert got == expected


def test_decimal_guard_and_strict_store(spark):
    cases = {"1.5": None, "1e-18": None, "1e-19": "SCALE_EXCEEDED", "9" * 20: None, "9" * 21: "PRECISION_EXCEEDED", "1e20": "PRECISION_EXCEEDED", "NaN": "NOT_FINITE_DECIMAL", "12345678901234567890.5": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.g for r in df.select("t", N.guard(F.col("t")).alias("g")).collect()} == cases
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("1e-30",)], "t string").select(N.stored(F.col("t"))).collect()


def test_session_date(spark):
    names = {"x-2026-07-30-a": "2026-07-30", "2026-13-01": None, "2026-07": None, "a-2026-00-10-2026-01-31": "2026-01-31", "plain": None}
    df = spark.createDataFrame([(k,) for k in names], "a string")
    assert {r.a: r.d for r in df.select("a", inference.session_date(F.col("a")).alias("d")).collect()} == names


def test_archive_and_tables_round_trip(spark, tmp_path):
    rows = frame_rows(spark).withColumns({
        "archive_schema_version": F.lit("1"), "collector_session_id": F.col("session_id"), "frame_encoding": F.lit("utf-8"),
        "raw_frame_byte_length": F.length("raw_frame").cast("long"), "message_type": F.lit(None).cast("string"),
        "source_channel": F.lit(None).cast("string"), "exchange_ts": F.lit(None).cast("timestamp"),
    })
    root = str(tmp_path / "archive")
    archive_source.write_archive(rows, root)
    back = archive_source.read_archive(spark, root)
    assert identity.compare_runs(rows.select("record_index", "raw_frame", "local_receipt_ts"), back.select("record_index", "raw_frame", "local_receipt_ts"), "record_index").collect()[0].identical
    part = next((tmp_path / "archive").rglob("*.json"))
    part.write_text(part.read_text() + "\n{broken\n")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert archive_source.read_archive(spark, root).count() == rows.count()
    with pytest.raises(Exception):
        archive_source.read_archive(spark, root, strict=True).collect()


def test_changed_file_is_found(spark, tmp_path):
    from tandemtape.operators import validation

    root = str(tmp_path / "t")
    spark.range(5).write.parquet(root)
    recorded = spark.createDataFrame(tables.content_hashes(spark, root).toPandas())
    spark.range(6).write.mode("append").parquet(root)
    states = {r.state for r in validation.compare_files(recorded, tables.content_hashes(spark, root)).collect()}
    assert states == {"EQUAL", "UNLISTED"}


def test_archive_tasks_are_bounded_and_write_sorted_shards(spark, tmp_path, monkeypatch):
    import json

    monkeypatch.setattr(archive_source, "FRAMES_PER_TASK", 50)
    monkeypatch.setattr(archive_source, "FRAMES_PER_SHARD", 20)
    rows = spark.range(600).select(
        F.lit("1").alias("archive_schema_version"), F.col("id").alias("record_index"), F.lit("s").alias("collector_session_id"), F.lit("kraken").alias("venue"),
        F.lit("BTC-USD").alias("canonical_instrument"), F.lit("BTC/USD").alias("venue_symbol"), F.timestamp_micros("id").alias("local_receipt_ts"),
        F.lit("text").alias("frame_type"), F.lit("utf-8").alias("frame_encoding"), F.lit("{}").alias("raw_frame"), F.lit(2).cast("long").alias("raw_frame_byte_length"),
        *[F.lit(None).cast("string").alias(c) for c in ("message_type", "source_channel")], F.lit(None).cast("timestamp").alias("exchange_ts"),
    )
    archive_source.write_archive(rows, str(tmp_path / "a"), 600)
    shards = [[json.loads(line)["record_index"] for line in f.read_text().splitlines()] for f in (tmp_path / "a").rglob("*.json")]
    assert len(shards) >= 6 and max(map(len, shards)) <= 200 and all(s == sorted(s) for s in shards)
    assert sorted(i for s in shards for i in s) == list(range(600))


NUMBERS = {  # text: above zero, zero or more
    "1": (True, True), "+.5": (True, True), "1e-30": (True, True), "0": (False, True), "-0.0": (False, True), "0e9": (False, True), "-.0E5": (False, True),
    "-5": (False, False), " -5": (False, False), "\t-5": (False, False), "1,5": (False, False), "": (False, False), "NaN": (False, False), "00.10 ": (True, True),
}


def test_signs_of_numbers_with_any_white_space_before(spark):
    frames = [(p, MATCH | {"price": t}) for t, (p, _) in NUMBERS.items()] + [(z, TICKER | {"best_bid_size": t}) for t, (_, z) in NUMBERS.items()]
    frames += [(z, kr("ticker", QUOTE | {"ask_qty": t})) for t, (_, z) in NUMBERS.items()]
    # Neither a boolean nor a nested value is a number, an id, a text or a time.
    frames += [(False, message | {name: value}) for message, names in ((MATCH, ("price", "trade_id", "side", "time")), (TICKER, ("best_ask_size", "sequence"))) for name in names for value in (True, [1], {"a": 1}, None)]
    rows = [(i, "kraken" if "channel" in m else "coinbase", "text", json.dumps(m)) for i, (_, m) in enumerate(frames)]
    df = spark.createDataFrame(rows, "record_index long, venue string, frame_type string, raw_frame string")
    kinds = {r.record_index: r.result_kind for r in parsing.classify(df).select("record_index", "result_kind").collect()}
    assert [kinds[i] in ("trade", "quote") for i in range(len(frames))] == [good for good, _ in frames]


def test_copies_are_numbered_without_the_frame_texts(spark):
    sessions = spark.createDataFrame([("s-coinbase", "a-1")], "session_id string, campaign_attempt_id string")
    ready = normalize.prepare(frame_rows(spark), sessions)
    plan = ready._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_frame#" not in plan and "payload#" not in plan
    assert ready.where("duplicate_count > 1").count() == 0 and ready.count() == len(CASES) + 4


def test_manifest_counts_what_was_given_to_the_writer(spark):
    from tandemtape.plans import frames as frame_plans
    from tandemtape.plans import quality as quality_plans
    from tandemtape.plans.registry import scratch
    from tandemtape.sources import samples

    folder = "/root/testdata/sf0.001"
    key, root = (spark.sparkContext.applicationId, folder), scratch(spark, "short-archive")
    archive_source.write_archive(samples.archive(spark, folder).where("record_index % 10 <> 3"), root)
    before = frame_plans._ARCHIVES.get(key)
    frame_plans._ARCHIVES[key] = root
    try:
        held = frame_plans.frames(spark, folder).count()
        listed = quality_plans.archive_state(spark, folder).agg(F.sum("manifest_records")).collect()[0][0]
    finally:
        frame_plans._ARCHIVES.pop(key)
        if before is not None:
            frame_plans._ARCHIVES[key] = before
    assert held < listed == samples.table(spark, folder, "events").count()


def test_only_wanted_fields_of_a_record_are_read(spark):
    classified = parsing.classify(frame_rows(spark))
    some = parsing.market_records(classified, "trade", ["source_sequence"])
    whole = parsing.market_records(classified, "trade").select(*some.columns)
    assert "event_ts" not in some.columns
    key = ["record_index", "child_index", "source_sequence"]
    assert sorted(map(tuple, some.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect())) != []
    assert "child_index" in parsing.market_records(classified, "quote", ()).columns
