"""Streaming forms over the archive layout: windows, counters, inactivity, duplicates, latest quotes, normalized tables.

Windows, activity periods and hashes leave the state once the watermark has passed them, and their rows go to a table on disk
when they do (append mode).  ``lateness`` says how far the arrival of frames may be out of order; a frame that is later than that is
left out.  A replay of stored shards reads them in the order in which they were written; ``replay_lateness`` measures how far out of
order that is.  An archive that is complete is sealed by a mark, a row at the end of time in a folder of its own,
which moves the watermark past every open window.  Marks are told apart after the aggregation, by a count of no frames: a filter on a
key would be moved below the watermark and take them away before they count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from tandemtape import schemas as S
from tandemtape.operators import identity, normalize, parsing
from tandemtape.schemas import ARCHIVE
from tandemtape.session import cut, release

OPEN, SEALED = "1970-01-01 00:00:00", "9999-01-01 00:00:00"


def mark(spark: SparkSession, marks: str, at: str = SEALED) -> None:
    """Add a mark; the one at ``OPEN`` only makes the folder."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("local_receipt_ts")).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(marks)


def read_stream(spark: SparkSession, root: str, files_per_trigger: int = 100, marks: str | None = None) -> DataFrame:
    """New shards of an archive as a stream, with the marks of a folder among them; a mark has no session."""
    read = lambda path: spark.readStream.schema(ARCHIVE).option("maxFilesPerTrigger", files_per_trigger).json(path).select(*ARCHIVE.names)
    rows = read(root).where(F.col("record_index").isNotNull())
    if marks is not None:
        rows = rows.unionByName(read(marks))
    return rows.withColumn("session_id", F.col("collector_session_id"))


def replay_lateness(spark: SparkSession, root: str) -> str:
    """How far frames come out of order when the shards are read as they were written: one row per shard is compared.

    The stream's file source keeps as much per shard itself.
    """
    shards = spark.read.schema(ARCHIVE).json(root).where(F.col("record_index").isNotNull())
    shards = shards.groupBy(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_modification_time").alias("written"))
    shards = shards.agg(F.min("local_receipt_ts").alias("first"), F.max("local_receipt_ts").alias("last"))
    # Shards of one moment may come in any order, so a shard is compared with all that are not newer.
    not_newer = Window.orderBy("written").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = F.unix_micros(F.max("last").over(not_newer)) - F.unix_micros("first")
    worst = shards.select(behind.alias("us")).agg(F.max("us")).first()[0]
    return f"{(worst or 0) // 1_000_000 + 1} seconds"


def minute_counts(frames: DataFrame, lateness: str = "10 minutes", ts: str = "local_receipt_ts") -> DataFrame:
    """Frames and bytes per session and one-minute receipt window."""
    return (
        frames.withWatermark(ts, lateness).groupBy("session_id", F.window(ts, "1 minute").alias("w"))
        .agg(F.count("session_id").alias("frames"), F.sum("raw_frame_byte_length").alias("bytes"))
        .where(F.col("frames") > 0).select("session_id", F.col("w.start").alias("window_start"), "frames", "bytes")
    )


def outcome_counters(frames: DataFrame, lateness: str = "10 minutes", ts: str = "local_receipt_ts") -> DataFrame:
    """Outcome counts per venue and minute, from the same parser as the batch."""
    parsed = parsing.classify(frames.withWatermark(ts, lateness))
    return (
        parsed.withColumn("outcome", parsing.outcome(F.col("result_kind"), F.col("records")))
        .groupBy("venue", F.window(ts, "1 minute").alias("w"), "outcome").agg(F.count("venue").alias("frames"))
        .where(F.col("frames") > 0).select("venue", F.col("w.start").alias("window_start"), "outcome", "frames")
    )


def quiet_periods(frames: DataFrame, timeout_seconds: int, lateness: str = "10 minutes", ts: str = "local_receipt_ts") -> DataFrame:
    """Activity periods split by silence; each period's end starts an inactivity longer than the timeout.

    A period is told once no frame can continue it any more, so each row is final.
    """
    return (
        frames.withWatermark(ts, lateness).groupBy("session_id", F.session_window(ts, f"{timeout_seconds} seconds").alias("w"))
        .agg(F.count("session_id").alias("frames"), F.max(ts).alias("last_frame"))
        .where(F.col("frames") > 0).select("session_id", F.col("w.start").alias("active_from"), "last_frame", "frames")
    )


def without_repeats(frames: DataFrame, lateness: str = "10 minutes", ts: str = "local_receipt_ts") -> DataFrame:
    """First copy of each frame within the watermark; the batch operator marks copies instead of dropping them."""
    hashed = frames.withColumn("frame_hash", identity.frame_hash(F.col("venue"), F.col("frame_type"), F.col("raw_frame")))
    return hashed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["session_id", "frame_hash"]).where(F.col("session_id").isNotNull())


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote per venue (update mode): the state an as-of join would read."""
    quote = F.struct("bid_price", "bid_size", "ask_price", "ask_size")
    return quotes.groupBy("venue").agg(
        F.max("ts_us").alias("ts_us"), F.max_by(quote, F.struct("ts_us", "record_index", "child_index")).alias("quote")
    )


# --- sinks ---------------------------------------------------------------------------------------------------------------
def append_table(rows: DataFrame, root: str, checkpoint: str):
    """Rows that are final go to a table whose log counts every micro-batch once."""
    return rows.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append")


def write_versions(rows: DataFrame, root: str, checkpoint: str):
    """The changed rows of each micro-batch as one version; a batch replayed after a failure overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def current(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The latest version of every key."""
    versions = spark.read.parquet(root)
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def finished(writer) -> None:
    """Run over what is there now."""
    writer.trigger(availableNow=True).start().awaitTermination()


TABLES = {"trades": normalize.trades, "top_of_book": normalize.quotes, "raw_record_outcomes": normalize.outcomes}


def normalize_stream(frames: DataFrame, sessions: DataFrame, root: str, checkpoint: str):
    """Normalize each micro-batch into the three typed tables and list the batch when all three are written.

    A batch is parsed once.  Its number is part of every path, so a batch replayed after a failure replaces what it left, and readers see
    listed batches only (``committed``).  Whether a frame is a copy is known when its session is complete; its marks stay
    null here and the batch operator gives them.
    """
    unknown = {"duplicate_count": "bigint", "occurrence_index": "bigint", "duplicate_class": "string"}

    def write(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("frame_hash", identity.frame_hash(F.col("venue"), F.col("frame_type"), F.col("raw_frame")))
        ready = cut(normalize.parsed(hashed.withColumns({c: F.lit(None).cast(t) for c, t in unknown.items()}), sessions))
        for name, build in TABLES.items():
            build(ready).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        listed = ready.agg(F.count(F.lit(1)).alias("frames"), F.min("local_receipt_ts").alias("first_receipt"), F.max("local_receipt_ts").alias("last_receipt"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/batch={number}")
        release(batch.sparkSession, ready)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of all listed batches of one table."""
    listed = spark.read.parquet(f"{root}/batches").select("batch").distinct()
    rows = spark.read.schema(S.table_schema(_COLUMNS[name]).add("batch", IntegerType())).parquet(f"{root}/{name}")
    return rows.join(listed, "batch", "left_semi").drop("batch")


_COLUMNS = {"trades": S.TRADE_COLUMNS, "top_of_book": S.QUOTE_COLUMNS, "raw_record_outcomes": S.OUTCOME_COLUMNS}
