"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key hash, documents, newest holder), partitioned and sorted by the hash.  A batch of documents is reduced to one row
per key; a merge anti-join with the runs finds the keys that no earlier batch held, and only these carry a holder; then the batch's
own run is added at level 0.  When a level is full, its runs are merged into one run of the next level, so a key is rewritten a
logarithmic number of times.  Feeding batches from the largest doc_id down makes the first holder the one whose lines stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import SPACE, lower_ascii, text_of
from tandemtape.session import cut, shared_folder

KEY = ["h1", "h2"]
LEAST_ID = -(2**63)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The levelled runs, in a folder that all executors reach."""

    def __init__(self, spark, folder: str | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.folder}/level-{level}-{uuid.uuid4().hex}"
        rows.select(*KEY, "docs", "holder").repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        self.levels[level].append(path)

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, docs long, holder long").parquet(*paths)

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self._read(paths) if paths else None

    def add(self, batch: DataFrame) -> None:
        """``batch`` has h1, h2 and did, a row per line; no did of an earlier batch comes again."""
        counted = batch.select(*KEY, "did").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("did").alias("holder"))
        known = self.runs()
        if known is not None:
            counted = cut(counted)
            fresh = counted.join(known.select(*KEY).hint("merge"), KEY, "left_anti")
            again = counted.join(known.select(*KEY).hint("merge"), KEY, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            counted = fresh.unionByName(again)
        self._write(counted, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._write(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        return self._read(paths).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def frequent(self, least: int) -> DataFrame:
        """Keys in at least so many documents, with the holder."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths).where(F.col("docs") >= least)


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with n_lines, n_dropped and kept_text.

    Lines are the pieces between ``\\n`` (a null or empty text has one empty line).  A key is the line stripped of white space with
    A-Z lower-cased; keys of at least ``least_chars`` code points held by at least ``least_docs`` documents lose their lines
    everywhere but in the largest doc_id that holds them.  Rows that share a doc_id are one document and lose the same lines; a null doc_id
    is the smallest id.  ``keep`` names the columns to carry (all by default); those that bear a name added here are replaced.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    keep = list(docs.columns if keep is None else keep)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    pieces = F.split(text_of("text"), "\n", -1)
    keyed = docs.select(did.alias("did"), F.xxhash64(text_of("text")).alias("th"), F.posexplode(F.transform(pieces, line_key)).alias("pos", "key"))
    lines = cut(keyed.where(F.length("key") >= least_chars).select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")))
    low, high = lines.agg(F.min("did"), F.max("did")).first()
    runs = LineRuns(docs.sparkSession)
    if low is not None:
        width = -(-(high - low + 1) // batches)
        top = high
        while top >= low:  # from the largest doc_id down
            runs.add(lines.where((F.col("did") <= top) & (F.col("did") > top - width)) if top - width >= LEAST_ID else lines.where(F.col("did") <= top))
            top -= width
        often = cut(runs.frequent(least_docs).select(*KEY, "holder"))
        drops = lines.join(often, KEY).where(F.col("did") < F.col("holder")).groupBy("did", "th").agg(F.collect_list("pos").alias("drops"))
    else:
        drops = lines.groupBy("did", "th").agg(F.collect_list("pos").alias("drops"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), did.alias("did"), F.xxhash64(text_of("text")).alias("th"), text_of("text").alias("_text"))
    rows = rows.join(drops, ["did", "th"], "left")
    pieces = F.split("_text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.coalesce("drops", F.array().cast("array<int>")))
    rows = rows.withColumn("n_lines", F.size(pieces).cast("long")).withColumn("n_dropped", (F.size(pieces) - F.size(stay)).cast("long"))
    rows = rows.withColumn("kept_text", F.when(F.col("drops").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n")))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in keep if c not in added], *added)
