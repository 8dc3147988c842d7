"""Raw frame archive: JSON lines under venue=/instrument=/date=/session= folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tandemtape.schemas import ARCHIVE

BAD = "_malformed"


def read_archive(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Scan all shards.  Blank lines are skipped; malformed records are dropped, or stop the job when ``strict``."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if strict:
        rows = reader.schema(ARCHIVE).option("mode", "FAILFAST").json(root)
    else:
        schema = StructType([*ARCHIVE.fields, StructField(BAD, StringType())])  # add() would change ARCHIVE itself
        rows = (
            reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(root)
            .where(F.col(BAD).isNull() & F.col("record_index").isNotNull()).drop(BAD)
        )
    return rows.withColumn("shard_path", shard_path(F.col("_metadata.file_path"))).withColumn(
        "session_id", F.col("collector_session_id")
    )


def shard_path(file_path):
    """Shard path below its session folder."""
    return F.regexp_extract(file_path, r"(?:session=[^/]+/)?((?:raw/)?[^/]+)$", 1)


FRAMES_PER_TASK = 100_000
FRAMES_PER_SHARD = 1_000_000


def write_archive(frames: DataFrame, root: str, count: int | None = None) -> None:
    """Write frames in the archive layout, one sorted set of shards per session.

    ``count``, the number of frames, decides how many tasks write, so that one sorts a bounded number of frames in memory: left to the
    size of the shuffled bytes, which frames alike pack many times over, tasks get so large that they spill.
    """
    date = F.date_format("local_receipt_ts", "yyyy-MM-dd")
    rows = frames.select(
        *ARCHIVE.names, F.col("canonical_instrument").alias("instrument"), date.alias("date"),
        F.col("collector_session_id").alias("session"), F.col("venue").alias("venue_key"),
    )
    # Sessions may be long: spread each over tasks by ranges of the record index.
    spread = ["session", F.floor(F.col("record_index") / FRAMES_PER_SHARD)]
    dealt = rows.repartition(*spread) if count is None else rows.repartition(max(8, -(-count // FRAMES_PER_TASK)), *spread)
    folders = ["venue_key", "instrument", "date", "session"]
    (
        # In the order of the folders the writer needs no sort of its own.
        dealt.sortWithinPartitions(*folders, "record_index")
        .write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy(*folders).json(root)
    )
