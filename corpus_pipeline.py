"""Training corpus from documents: drop toxic texts, keep one of each near-copy group, decontaminate, mix sources, shard.

Every stage is a function (spark, docs, sf_dir) whose result is written as Parquet and reread as the next stage's documents.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tandemtape.llm import mixing, ngramjoin, sharding, templates, toxicity
from tandemtape.llm.registry import table
from tandemtape.session import CUTS, release, shared_folder


_LAST: list[str] = []


def stage(fn):
    """Removes what the stage before left in the shared folder, unless ``docs`` still reads it: its result has been written by then."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LAST and not any(root.split(":")[-1].lstrip("/") in file for root in _LAST for file in docs.inputFiles()):
            release(spark, *[root for root in _LAST if root in CUTS])
            _LAST.clear()
        before = set(CUTS)
        result = fn(spark, docs, sf_dir)
        _LAST.extend(root for root in CUTS if root not in before)
        return result

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the string-kernel machine does not predict toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return ngramjoin.one_of_each(docs, width=5, percent=80)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, also with other numbers, names or units."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row per use of a document, in training order."""
    return mixing.curriculum(docs)


@stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.kd_shards(docs, shards=40)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL has no counterpart of the trained machine; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, step) in enumerate(STAGES):
        result, path = step(spark, docs, sf_dir), f"{root}/{number}-{name}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
