"""Cross-products of a two-column series as Spark aggregates.

Every least-squares problem here needs only sums of y_i(t) y_j(t-d) for small d.  Those are one aggregate over the
rows; the rows near both ends, needed to move a sum to another sample window, are a bounded handful per key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.operators.ordered import haloed
from tandemtape.operators.sync import CELLS

DEPTH = 13
PAIRS = ((1, 1), (1, 2), (2, 1), (2, 2))


def lagged(rows: DataFrame, keys: list[str], depth: int, columns: tuple[str, ...] = ("y1", "y2")) -> DataFrame:
    """Add ``<column>_<d>`` for d = 1..depth, the value d positions earlier (null before the start)."""
    halo, track = haloed(rows, keys, "pos", back=depth, size=CELLS)
    w = track.window()
    added = [F.lag(c, d).over(w).alias(f"{c}_{d}") for c in columns for d in range(1, depth + 1)]
    return halo.select(*rows.columns, "_own", *added).where("_own").drop("_own")


def lag_products(rows: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """Per key: n, sums, extremes, products at lags 0..depth, and the first and last depth + 1 rows."""
    wide = lagged(rows, keys, depth)
    at = lambda j, d: F.col(f"y{j}") if d == 0 else F.col(f"y{j}_{d}")
    sums = [
        F.sum(F.col(f"y{i}") * at(j, d)).alias(f"c_{i}{j}_{d}") for i, j in PAIRS for d in range(depth + 1)
    ]
    totals = wide.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum("y1").alias("s_1"), F.sum("y2").alias("s_2"),
        F.min("y1").alias("min_1"), F.max("y1").alias("max_1"), F.min("y2").alias("min_2"), F.max("y2").alias("max_2"),
        *sums,
    )
    packed = totals.select(
        *keys, "n", F.array("s_1", "s_2").alias("sums"),
        ((F.col("min_1") == F.col("max_1")) | (F.col("min_2") == F.col("max_2"))).alias("flat"),
        (F.col("min_1") == F.col("max_1")).alias("flat_1"), (F.col("min_2") == F.col("max_2")).alias("flat_2"),
        F.array(*[F.coalesce(f"c_{i}{j}_{d}", F.lit(0.0)) for i, j in PAIRS for d in range(depth + 1)]).alias("products"),
    )
    # At most depth + 1 rows per key pass each filter.
    ends = rows.where((F.col("pos") <= depth) | (F.col("pos") >= F.col("n") - depth - 1)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "y1", "y2"))).alias("_e")
    ).select(
        *keys, F.col("_e.pos").alias("edge_pos"), F.col("_e.y1").alias("edge_1"), F.col("_e.y2").alias("edge_2")
    )
    return packed.join(ends, keys)


class WindowedGram:
    """Products and sums of one key, re-windowed: sum over t in [t0, n) of y_i(t-a) y_j(t-b)."""

    def __init__(self, n, sums, products, edge_pos, edge_1, edge_2):
        self.n, self.sums = int(n), np.asarray(sums, dtype=float)
        grid = np.asarray(products, dtype=float).reshape(len(PAIRS), -1)  # as many lags as were summed
        self.at = {pair: grid[k] for k, pair in enumerate(PAIRS)}
        self.edge = {1: dict(zip(edge_pos, edge_1)), 2: dict(zip(edge_pos, edge_2))}

    def total(self, i: int, a: int, t0: int) -> float:
        outside = list(range(0, t0 - a)) + list(range(self.n - a, self.n))
        return float(self.sums[i - 1] - sum(self.edge[i][s] for s in outside))

    def product(self, i: int, a: int, j: int, b: int, t0: int) -> float:
        if a > b:
            return self.product(j, b, i, a, t0)
        d = b - a
        outside = list(range(d, t0 - a)) + list(range(self.n - a, self.n))
        return float(self.at[i, j][d] - sum(self.edge[i][s] * self.edge[j][s - d] for s in outside))

    def gram(self, terms: list[tuple[int, int] | None], t0: int) -> np.ndarray:
        """Gram matrix of the listed terms; ``None`` is the constant, (i, a) is y_i(t-a)."""
        size = len(terms)
        out = np.empty((size, size))
        for p, u in enumerate(terms):
            for q in range(p, size):
                v = terms[q]
                if u is None and v is None:
                    value = float(self.n - t0)
                elif u is None or v is None:
                    value = self.total(*(u or v), t0)
                else:
                    value = self.product(*u, *v, t0)
                out[p, q] = out[q, p] = value
        return out


def solve_scaled(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse of a Gram system after scaling its diagonal to one."""
    scale = 1.0 / np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(gram * np.outer(scale, scale)) * np.outer(scale, scale)
    return inverse @ right, inverse


def level_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Products for the error-correction model: changes now, changes one step ago, levels one step ago."""
    wide = lagged(rows, keys, 2).where("pos >= 2")
    terms = {
        "d1": F.col("y1") - F.col("y1_1"), "d2": F.col("y2") - F.col("y2_1"),
        "z1": F.col("y1_1") - F.col("y1_2"), "z2": F.col("y2_1") - F.col("y2_2"),
        "l1": F.col("y1_1"), "l2": F.col("y2_1"),
    }
    named = wide.select(*keys, "n", *[v.alias(k) for k, v in terms.items()])
    # Centre per key before multiplying: levels wander far from zero.
    middle = named.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in terms])
    centred = named.join(middle, keys).select(*keys, "n", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in terms])
    names = list(terms)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = centred.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs],
    )
    return sums.select(*keys, "n", "rows", F.array(*[f"p_{a}_{b}" for a, b in pairs]).alias("products"))
