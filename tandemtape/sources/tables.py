"""Normalized and result tables on Parquet: scans, sinks, views, inventories and content hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtape import schemas as S

# Writer settings of the stored tables.
WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.enable.dictionary": "true"}
TABLES = {"trades": S.TRADES, "top_of_book": S.QUOTES, "raw_record_outcomes": S.OUTCOMES}
ROWS_PER_BLOCK = 1_000_000


def read_table(spark: SparkSession, root: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan with an explicit schema; naming columns prunes the read."""
    rows = spark.read.schema(schema).parquet(root)
    return rows.select(*columns) if columns else rows


def read_listed(spark: SparkSession, root: str, schema: T.StructType, manifest: DataFrame, path: str = "relative_path") -> DataFrame:
    """Only rows of files named in a manifest, matched on the path below the root."""
    rows = spark.read.schema(schema).parquet(root).withColumn(path, below(root))
    return rows.join(manifest.select(path).distinct(), path, "left_semi")


def below(root: str):
    """Path of the row's file below ``root``."""
    return F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1)


def write_partitioned(rows: DataFrame, root: str, receipt: str = "receipt_timestamp_utc") -> None:
    """Partitioned sink: (venue, date, session); the date is that of the session's first receipt.

    Sessions are split into blocks of record indices, so a long one is written by many tasks, each file sorted.
    """
    first = rows.groupBy("venue", "session_id").agg(F.min(receipt).alias("_first"))
    placed = rows.join(first, ["venue", "session_id"]).withColumn("date", F.date_format("_first", "yyyy-MM-dd"))
    block = F.floor(F.col("source_record_index") / ROWS_PER_BLOCK)
    order = ["source_record_index"] + (["normalized_child_index"] if "normalized_child_index" in rows.columns else [])
    out = placed.drop("_first").withColumn("session", F.col("session_id")).withColumn("venue_key", F.col("venue"))
    (
        out.repartition("venue_key", "session", block).sortWithinPartitions("venue_key", "session", *order)
        .write.mode("overwrite").options(**WRITER).partitionBy("venue_key", "date", "session").parquet(root)
    )


def write_results(tables: Mapping[str, DataFrame], root: str) -> None:
    """Result tables, one folder each; empty tables keep their schema."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").options(**WRITER).parquet(f"{root}/{name}")


def inventory(spark: SparkSession, root: str, schema: T.StructType, index: str, receipt: str) -> DataFrame:
    """Per file: rows, bytes, index and receipt bounds, schema fingerprint."""
    rows = spark.read.schema(schema).parquet(root)
    return rows.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("byte_size")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(index).alias("first_index"), F.max(index).alias("last_index"),
        F.min(receipt).alias("first_receipt"), F.max(receipt).alias("last_receipt"),
    ).withColumn("schema_fingerprint", F.sha2(F.lit(schema_text(schema)), 256))


def schema_text(schema: T.StructType) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)


def content_hashes(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 and size of each file.  For tables of any size use the order-free row fingerprint instead."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.substring_index("path", root.rstrip("/") + "/", -1).alias("relative_path"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("byte_size"),
    )


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Views by table name, plus the stream of all events and two summaries."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    if {"trades", "top_of_book"} <= set(tables):
        from tandemtape.operators.normalize import event_stream

        event_stream(tables["trades"], tables["top_of_book"]).createOrReplaceTempView("normalized_event_stream")
    if "raw_record_outcomes" in tables:
        session_summary(tables["raw_record_outcomes"]).createOrReplaceTempView("session_summary")
        venue_summary(tables["raw_record_outcomes"]).createOrReplaceTempView("venue_summary")


def session_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("venue", "session_id").agg(
        F.count(F.lit(1)).alias("raw_record_count"), F.min("local_receipt_ts").alias("first_local_receipt_ts"),
        F.max("local_receipt_ts").alias("last_local_receipt_ts"), F.sum("normalized_trade_row_count").alias("trade_count"),
        F.sum("normalized_bbo_row_count").alias("top_of_book_count"),
        F.count_if(F.col("parse_status") == "ERROR").alias("parse_error_count"),
        F.count_if("is_raw_frame_duplicate").alias("duplicate_raw_frame_count"),
    )


def venue_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("venue").agg(
        F.count(F.lit(1)).alias("raw_record_count"), F.sum("normalized_trade_row_count").alias("trade_count"),
        F.sum("normalized_bbo_row_count").alias("top_of_book_count"),
    )


def row_counts(outcomes: DataFrame) -> DataFrame:
    """Counts for manifests by session, attempt, venue and (venue, outcome), as rows."""
    sets = F.count(F.lit(1)).alias("raw_records"), F.sum("normalized_trade_row_count").alias("trade_rows"), F.sum("normalized_bbo_row_count").alias("quote_rows")
    out = None
    for scope, columns in (
        ("session", ["session_id"]), ("attempt", ["campaign_attempt_id"]), ("venue", ["venue"]), ("venue_outcome", ["venue", "normalization_outcome"]),
    ):
        line = outcomes.groupBy(*columns).agg(*sets).select(
            F.lit(scope).alias("scope"), F.concat_ws("|", *columns).alias("name"), "raw_records", "trade_rows", "quote_rows"
        )
        out = line if out is None else out.unionAll(line)
    return out
