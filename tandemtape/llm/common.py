"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space is the blank and the control characters 9 to 13; everything else belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def drop_shuffles_early(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of a query when the query ends, not when the driver next collects its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bytes of a batch that Spark hands to Python at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the batches of jobs run inside by their bytes: ten thousand texts or sets at once fill a task's memory on both sides.

    A row is never cut.  The session's own setting holds again afterwards.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def text_of(column: Column | str) -> Column:
    """The text, empty where there is none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column | str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def running(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows of the key that come before this one, in the order (``part``, ``order``).

    No window holds a whole key: ``part`` cuts it into ordered pieces, their totals are summed first (map-side combined), and each
    row adds the total of the pieces before its own.  Hand in a stored table, since it is read twice.
    """
    totals = df.groupBy(*keys, part).agg(F.sum(value).alias("_of_part"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, part, F.coalesce(F.sum("_of_part").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, [*keys, part])
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def parts_for(rows: int, per_part: int, least: int = 64) -> int:
    """How many pieces keep each near ``per_part`` rows."""
    return max(least, -(-rows // per_part))
