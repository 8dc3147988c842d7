"""Streams against hand-made shards: late rows, state that leaves, sealed archives, replayed batches."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tandemtape.streaming import streams

START = datetime(2026, 7, 30, 12)
MATCH = {"type": "match", "trade_id": 5, "sequence": 9, "time": "2026-07-30T12:00:00Z", "product_id": "BTC-USD", "side": "sell", "size": "0.5", "price": "1.0000000004"}
TICKER = {"type": "ticker", "sequence": 1, "product_id": "BTC-USD", "best_bid": "1.0000000004", "best_bid_size": "0", "best_ask": "1.0000000006", "best_ask_size": "2", "time": "2026-07-30T12:00:00Z"}


def shard(root, number, seconds, session="s-1", frame=MATCH):
    """A shard of frames received at these seconds, written after the shards before it."""
    path = root / f"part-{number:05d}.json"
    rows = [
        {"record_index": number * 100 + i, "collector_session_id": session, "venue": "coinbase", "canonical_instrument": "BTC-USD", "venue_symbol": "BTC-USD",
         "local_receipt_ts": (START + timedelta(seconds=s)).isoformat() + "Z", "frame_type": "text", "raw_frame": json.dumps(frame), "raw_frame_byte_length": 10}
        for i, s in enumerate(seconds)
    ]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def drained(spark, root, tmp, build):
    """Final rows after all shards, again after the seal, and how many rows the state held at the end of each run."""
    marks, table, checkpoint = (str(tmp / name) for name in ("marks", "table", "checkpoint"))
    streams.mark(spark, marks, streams.OPEN)
    counts, held = [], []
    for seal in (False, True):
        if seal:
            streams.mark(spark, marks)
        rows = build(streams.read_stream(spark, str(root), files_per_trigger=1, marks=marks))
        query = streams.append_table(rows, table, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        counts.append(spark.read.schema(rows.schema).parquet(table).collect())
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    return counts, held


def test_windows_leave_the_state_and_late_rows_are_left_out(spark, tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    shard(root, 0, [0, 10, 70])
    shard(root, 1, [3600, 3601])
    shard(root, 2, [3640])
    shard(root, 3, [20, 3650])  # The first is an hour late; a watermark holds from the batch after the one that moved it.
    (before, after), (open_rows, left) = drained(spark, root, tmp_path, lambda f: streams.minute_counts(f, "10 minutes"))
    named = lambda rows: {(r.window_start - START).seconds // 60: r.frames for r in rows}
    assert named(before) == {0: 2, 1: 1}
    assert named(after) == {0: 2, 1: 1, 60: 4}
    assert open_rows == 1 and left == 1  # In the end, the window of the mark itself.


def test_a_lateness_that_covers_the_disorder_loses_nothing(spark, tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    shard(root, 0, [0, 10, 70])
    shard(root, 1, [3600, 3601])
    shard(root, 2, [20, 3650])
    assert streams.replay_lateness(spark, str(root)) == "3631 seconds"
    (_, after), _ = drained(spark, root, tmp_path, lambda f: streams.minute_counts(f, streams.replay_lateness(spark, str(root))))
    assert sum(r.frames for r in after) == 7


def test_quiet_periods_are_told_once_and_final(spark, tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    shard(root, 0, [0, 100, 200])
    shard(root, 1, [150, 1000])
    shard(root, 2, [5000])
    (before, after), (_, left) = drained(spark, root, tmp_path, lambda f: streams.quiet_periods(f, 300, "5 minutes"))
    told = lambda rows: sorted(((r.active_from - START).seconds, (r.last_frame - START).seconds, r.frames) for r in rows)
    assert told(before) == [(0, 200, 4), (1000, 1000, 1)]
    assert told(after) == [(0, 200, 4), (1000, 1000, 1), (5000, 5000, 1)] and left == 1


def test_repeats_are_dropped_while_their_hash_is_held(spark, tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    shard(root, 0, [0, 1])
    shard(root, 1, [2, 30])
    (_, after), _ = drained(spark, root, tmp_path, lambda f: streams.without_repeats(f, "1 hour").select("session_id", "record_index"))
    assert len(after) == 1


def test_normalized_tables_count_listed_batches_once(spark, tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    shard(root, 0, [0, 1])
    shard(root, 1, [2], frame=TICKER)
    sessions = spark.createDataFrame([("s-1", "a-1", "1.0", "set")], "session_id string, campaign_attempt_id string, normalized_schema_version string, validated_dataset_manifest_id string")
    out, checkpoint = str(tmp_path / "tables"), tmp_path / "checkpoint"

    def run():
        frames = streams.read_stream(spark, str(root), files_per_trigger=1).withColumn("shard_path", F.lit("raw/part-00000.jsonl"))
        streams.finished(streams.normalize_stream(frames, sessions, out, str(checkpoint)))
        return {name: streams.committed(spark, out, name) for name in streams.TABLES}

    tables = run()
    assert {name: rows.count() for name, rows in tables.items()} == {"trades": 2, "top_of_book": 1, "raw_record_outcomes": 3}
    quote = tables["top_of_book"].first()
    assert quote.spread == Decimal("2E-10")
    assert quote.campaign_attempt_id == "a-1" and len(quote.normalized_event_id) == 64 and quote.is_raw_frame_duplicate is None
    # The driver is lost after the tables were written and before the batch counted as done: it runs again.
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert {name: rows.count() for name, rows in run().items()} == {"trades": 2, "top_of_book": 1, "raw_record_outcomes": 3}
    # Tables of a batch that is not listed are not read.
    streams.committed(spark, out, "trades").write.parquet(f"{out}/trades/batch=99")
    assert streams.committed(spark, out, "trades").count() == 2


def test_versions_keep_the_latest_of_each_key(spark, tmp_path):
    root = str(tmp_path / "v")
    for number, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        spark.createDataFrame(rows, "venue string, n int").write.parquet(f"{root}/batch={number}")
    assert {(r.venue, r.n) for r in streams.current(spark, root, ["venue"]).collect()} == {("a", 2), ("b", 1)}
