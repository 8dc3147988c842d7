"""Registration of named queries and the SQL text blocks their counterparts are built from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtape.session import shared_folder
from tandemtape.sources import samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint location."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_STAGES: dict[tuple[str, str, str], tuple] = {}


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table (classified frames, session metrics, lattice) written once per application and then scanned.

    Several queries of one stage read the same stored table, as the stages of a batch run do.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGES:
        rows, root = build(), scratch(spark, name)
        rows.write.parquet(root)
        _STAGES[key] = (root, rows.schema)
    root, schema = _STAGES[key]
    return spark.read.schema(schema).parquet(root)


def forget_stages() -> None:
    """Make the next queries build their stage tables again (the bench times them in full)."""
    _STAGES.clear()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded alike on both sides, as sums in Spark have no fixed order.

    Adding zero turns a rounded -0.0 into 0.0.
    """
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# SQL blocks: each may use the ones before it.
BLOCKS: dict[str, str] = {
    "base": samples.base_sql(samples.DUCK_TOKENS),
    "ticks": samples.ticks_sql(),
    "framed": samples.frames_sql(),
    "archive": samples.archive_sql(samples.DUCK_TOKENS),
}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def using(names: str, body: str) -> str:
    """``WITH`` the named blocks, then the body."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n]})" for n in names.split()) + "\n" + body
