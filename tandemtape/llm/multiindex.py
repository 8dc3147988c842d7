"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own, so a cell is a pair of centroids.  For a query, cells are taken in
the order of the summed distances of its halves to the two centroids, by a heap over the pairs, until they hold the wanted share
of all vectors; their entries are ranked by exact distance.

Codebooks and the share are fitted on a hash sample of about ``sample_rows`` vectors: the share is the smallest at which exact neighbours
within the sample are found with the wanted recall.  In the whole table neighbours are nearer and the recall higher.
Cells are found on vectors moved by the sample's medians and divided by its usual size; scores come from differences of the original ones.
Every vector is indexed.  Cells are gathered into blocks of about ``block_rows`` entries, a larger cell takes several blocks, and a
block meets the queries that reach it as one matrix product, in slices of a bounded number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.session import cut


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: not null, not zero, finite, of the commonest length; repeated rows once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, finite)).where(F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (length["n"] if length else 0)).distinct()


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (np.square(centroids).sum(1) - 2 * x @ centroids.T).argmin(1) if len(x) else np.zeros(0, np.int64)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's method from random rows under a fixed seed; empty clusters keep their centroid."""
    pick = np.random.default_rng(7).permutation(len(x))[:size]
    centroids = x[pick].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis; squares that leave the range of doubles are taken of differences divided by their largest."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = q - x
        out = np.sqrt(np.square(apart).sum(-1))
        odd = ~((out > 1e-150) & (out < 1e150))
        if odd.any():
            most = np.abs(apart[odd]).max(-1)
            unit = np.where((most > 0) & np.isfinite(most), most, 1.0)
            out[odd] = np.where(np.isfinite(most), most * np.sqrt(np.square(apart[odd] / unit[:, None]).sum(-1)), np.inf)
    return out


def nearest_rows(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` nearest allowed rows: positions, distances and whether there is such a row.

    One product of the centred matrices finds candidates.  Where its rounding could hide a nearer row, that query is measured against all.
    """
    few = min(k + 16, len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        centre = x.mean(0)
        a, b = q - centre, x - centre
        long_a, long_b = np.square(a).sum(1), np.square(b).sum(1)
        near = long_a[:, None] - 2 * a @ b.T + long_b[None]
        error = 8 * np.finfo(float).eps * (x.shape[1] + 2) * (long_a + long_b.max())
        near = np.where(allowed, near, np.inf)
        picked = np.argpartition(near, few - 1, 1)[:, :few]
        found = np.sort(np.take_along_axis(near, picked, 1), 1)
        sure = (allowed.sum(1) <= few) | (found[:, -1] - error > found[:, min(k, few) - 1] + error)
        sure &= np.isfinite(error)
    score = distances(q[:, None], x[picked])
    real = np.take_along_axis(allowed, picked, 1)
    order = np.lexsort((ids[picked], np.where(real, score, np.inf), ~real), axis=1)[:, :k]
    at, score, real = (np.take_along_axis(v, order, 1) for v in (picked, score, real))
    for i in np.flatnonzero(~sure):
        full = distances(q[i][None], x)
        order = np.lexsort((ids, full, ~allowed[i]))[:k]
        at[i], score[i], real[i] = order, full[order], allowed[i][order]
    return at, score, real


@dataclass
class MultiIndex:
    half: int
    left: np.ndarray
    right: np.ndarray
    share: float
    centre: np.ndarray
    scale: float

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Vectors near the origin and of usual size; far-off components are cut to a thousand sizes, which only places them in a cell."""
        with np.errstate(over="ignore"):
            return np.clip((x - self.centre) / self.scale, -1e3, 1e3)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x[:, : self.half], self.left) * len(self.right) + nearest_centroid(x[:, self.half :], self.right)

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Cells by summed distance: a heap holds the frontier of pairs of the two sorted centroid lists."""
        a = np.square(self.left - query[: self.half]).sum(1)
        b = np.square(self.right - query[self.half :]).sum(1)
        by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = np.sort(a).tolist(), np.sort(b).tolist()
        many, heap, reached = len(by_b), [(a[0] + b[0], 0, 0)], [0] * len(a)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i] * many + by_b[j]
            # (i + 1, j) is due once (i + 1, j - 1) has gone, and (i, j + 1) once (i - 1, j + 1) has.
            reached[i] = j + 1
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < many and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))

    def visited(self, query: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
        """Cells with entries, in order, until they hold ``least`` entries."""
        found, held = [], 0
        for cell in self.order(query):
            if counts[cell]:
                found.append(cell)
                held += int(counts[cell])
                if held >= least:
                    break
        return found


def fit(sample: np.ndarray, rows: int, k: int, recall: float, probes: int = 256, most: int = 256) -> MultiIndex:
    centre = np.median(sample, axis=0)
    with np.errstate(over="ignore"):
        spread = np.minimum(np.abs(sample - centre), np.finfo(float).max)
    scale = float(np.quantile(spread, 0.99)) or float(spread.max()) or 1.0
    size = int(np.clip(2 ** round(np.log2(max(np.sqrt(rows / 4), 1))), 4, most))
    half = sample.shape[1] // 2
    index = MultiIndex(half, np.zeros((1, half)), np.zeros((1, 1)), 1.0, centre, scale)
    sample = index.moved(sample)
    index.left, index.right = codebook(sample[:, :half], size if half else 1), codebook(sample[:, half:], size)
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.left) * len(index.right))
    needs = []
    for i in range(min(probes, len(sample))):
        distance = np.square(sample - sample[i]).sum(1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
        held = np.zeros(len(counts), np.int64)
        visited = index.visited(sample[i], counts, len(sample))
        held[visited] = np.cumsum(counts[visited])
        needs.extend(held[cells[near]] / len(sample))
    index.share = float(min(1.0, np.quantile(needs, recall, method="higher") + 1 / len(sample))) if needs else 1.0
    return index


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.95, sample_rows: int = 20_000, block_rows: int = 4_096, slice_queries: int = 2_048) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by Euclidean distance, of every row whose vec_id ``every`` divides.

    A query's own vec_id is no candidate; ties go to the smaller vec_id; fewer candidates give fewer rows.  Vectors that are null,
    zero, not finite or of an odd length neither ask nor answer; repeated rows count once; an empty table gives an empty table.  Of
    rows with one and the same vector only the ``k + 1`` smallest ids can be among any query's nearest, so only these are indexed.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = cut(rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1).drop("_copy"))
    count = indexed.count()
    schema = "query_id long, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    slot = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000))
    sample = rows.where(slot <= int(1_000_000 * sample_rows / count)).orderBy("vec_id").toPandas() if count > sample_rows else rows.orderBy("vec_id").limit(sample_rows).toPandas()
    index = fit(np.vstack(sample["embedding"].to_numpy()), count, k, recall)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(index.moved(matrix(b.column("embedding")))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cells, pa.int32())], ["vec_id", "embedding", "cell"])

    entries = cut(indexed.mapInArrow(assign, "vec_id long, embedding array<double>, cell int"))
    held = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 256 * 256 rows
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    counts[held["cell"].to_numpy(np.int64)] = held["n"].to_numpy(np.int64)
    # Consecutive cells share a block; a cell above the size of a block has several of its own.
    parts = np.maximum(1, -(-counts // block_rows))
    first, block, filled = np.zeros(len(counts), np.int64), 0, 0
    for cell in np.flatnonzero(counts):
        if filled and filled + counts[cell] > block_rows:
            block, filled = block + 1, 0
        first[cell] = block
        filled += int(counts[cell])
        if parts[cell] > 1:
            block, filled = block + int(parts[cell]), 0
    table = spark.createDataFrame(pd.DataFrame({"cell": np.flatnonzero(counts), "first": first[counts > 0], "parts": parts[counts > 0]}), "cell int, first long, parts long")
    blocks = entries.join(F.broadcast(table), "cell").select("vec_id", "embedding", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    least = int(np.ceil(index.share * count)) + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, of, cells = [], [], []
            for i, q in enumerate(index.moved(matrix(b.column("embedding"))) if b.num_rows else ()):
                wanted: dict[int, list[int]] = {}
                for cell in index.visited(q, counts, least):
                    for part in range(int(parts[cell])):
                        wanted.setdefault(int(first[cell]) + part, []).append(cell)
                at += [i] * len(wanted)
                of += list(wanted)
                cells += list(wanted.values())
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(took), b.column("embedding").take(took), pa.array(of, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                ["query_id", "query", "block", "cells"],
            )

    asking = queries.count()
    slices = max(1, -(-asking // slice_queries))
    # A number of parts that adaptive execution does not merge: a query costs far more than its bytes tell.
    probes = queries.repartition(max(1, -(-asking // 64)), "vec_id").mapInArrow(probe, "query_id long, query array<double>, block long, cells array<int>")
    probes = cut(probes.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices))))
    asked = probes.select("block", "slice").distinct()

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids = np.vstack(left["embedding"].to_numpy()), left["vec_id"].to_numpy(np.int64)
        names, at = np.unique(left["cell"].to_numpy(), return_inverse=True)
        out = []
        for start in range(0, len(right), 256):
            some = right.iloc[start : start + 256]
            q, own = np.vstack(some["query"].to_numpy()), some["query_id"].to_numpy(np.int64)
            reached = np.array([np.isin(names, c) for c in some["cells"]])
            at_row, score, keep = nearest_rows(q, x, reached[:, at] & (own[:, None] != ids[None]), ids, k)
            out.append(pd.DataFrame({"query_id": np.broadcast_to(own[:, None], score.shape)[keep], "vec_id": ids[at_row][keep], "score": score[keep]}))
        return pd.concat(out)

    spread = blocks.join(asked, "block")
    sliced = probes.select("query_id", "query", "cells", F.col("block").alias("_block"), F.col("slice").alias("_slice"))
    found = spread.groupBy("block", "slice").cogroup(sliced.groupBy("_block", "_slice")).applyInPandas(rank, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
