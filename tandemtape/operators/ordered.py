"""Ordered passes over sequences of any length.

A window partitioned by session or attempt alone puts the longest sequence into one task.  Here a sequence is cut
into slices of a bounded number of positions; each slice is its own window partition, and what it needs from earlier
slices (last value seen, running total) comes from one small aggregate row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = 1 << 18


@dataclass(frozen=True)
class Track:
    """``keys`` name a sequence, ``order`` is its total order, ``slice`` the column holding the slice number."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slice: str = "_slice"

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, self.slice).orderBy(*self.order)


def later_rows(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows after the current one, as those before it in falling order: the nearest of them is the frame's last.

    A frame that grows costs one step per row; one that runs from the current row to the end is read anew for each row.
    """
    falling = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return falling.rowsBetween(Window.unboundedPreceding, -1)


def sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str | Column, size: int = SLICE
) -> tuple[DataFrame, Track]:
    """Number the slices by ``position div size``; position must not decrease along ``order``."""
    at = F.col(position) if isinstance(position, str) else position
    return df.withColumn("_slice", F.floor(at / size)), Track(tuple(keys), tuple(order))


def carry(
    df: DataFrame,
    track: Track,
    *,
    before: Mapping[str, Column | tuple[Column, Column]] | None = None,
    upto: Mapping[str, Column | tuple[Column, Column]] | None = None,
    after: Mapping[str, Column | tuple[Column, Column]] | None = None,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add order-dependent columns in one pass.

    ``before``: value at the latest earlier row, ``upto``: value at the latest row up to the current one, ``after``:
    value at the earliest later row; each may be a pair (value, condition) to look only at rows meeting the condition.  ``sums``: running total, current included;
    ``totals``: total over the whole sequence.

    ``df`` is read twice, once for the slice rows: hand in a scan or a cut table, not a long pipeline.
    """
    before, upto, after = dict(before or {}), dict(upto or {}), dict(after or {})
    sums, totals = dict(sums or {}), dict(totals or {})
    looks = {**before, **upto, **after}
    position = F.struct(*[F.col(c) for c in track.order])
    seen: dict[str, Column] = {}
    for name, spec in looks.items():
        value, where = spec if isinstance(spec, tuple) else (spec, None)
        boxed = F.struct(value.alias("v"))
        seen[name] = F.when(where, boxed) if where is not None else boxed

    tails = df.groupBy(*track.keys, track.slice).agg(
        *[(F.min if n in after else F.max)(F.when(box.isNotNull(), F.struct(position.alias("p"), box.alias("b")))).alias(f"_t_{n}")
          for n, box in seen.items()],
        *[F.sum(v).alias(f"_s_{n}") for n, v in {**sums, **totals}.items()],
    )
    earlier = (
        Window.partitionBy(*track.keys).orderBy(track.slice).rowsBetween(Window.unboundedPreceding, -1)
    )
    later = later_rows(track.keys, [track.slice])
    beyond = lambda n: F.last(F.col(f"_t_{n}.b"), ignorenulls=True).over(later if n in after else earlier)
    tails = tails.select(
        *track.keys, track.slice,
        *[beyond(n).alias(f"_c_{n}") for n in seen],
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_a_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*track.keys)).alias(f"_a_{n}") for n in totals],
    )
    within = track.window()
    past = within.rowsBetween(Window.unboundedPreceding, -1)
    present = within.rowsBetween(Window.unboundedPreceding, 0)
    rest = later_rows([*track.keys, track.slice], track.order)
    inside = lambda n, box: F.last(box, ignorenulls=True).over(rest if n in after else past if n in before else present)
    joined = df.join(tails, [*track.keys, track.slice], "left")
    added = [
        F.coalesce(inside(n, box), F.col(f"_c_{n}"))["v"].alias(n)
        for n, box in seen.items()
    ]
    added += [
        (F.coalesce(F.sum(v).over(present), F.lit(0)) + F.coalesce(F.col(f"_a_{n}"), F.lit(0))).alias(n)
        for n, v in sums.items()
    ]
    added += [F.col(f"_a_{n}").alias(n) for n in totals]
    return joined.select(*df.columns, *added)


def haloed(
    df: DataFrame, keys: Sequence[str], position: str, *, back: int = 0, ahead: int = 0, size: int = SLICE
) -> tuple[DataFrame, Track]:
    """Slices that also hold copies of the ``back`` earlier and ``ahead`` later positions of their neighbours.

    Windows over the track then see every row within that reach; keep the rows with ``_own`` afterwards.
    """
    at = F.col(position)
    first, last = F.floor((at - ahead) / size), F.floor((at + back) / size)
    out = df.withColumn("_slice", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_slice") == F.floor(at / size)
    )
    return out, Track(tuple(keys), (position,))


def longest_run(df: DataFrame, keys: Sequence[str], run: str, start: str) -> DataFrame:
    """Earliest longest run per key from rows labelled with a run id: run, length, first and last position."""
    lengths = df.groupBy(*keys, run).agg(
        F.count(F.lit(1)).alias("run_length"), F.min(start).alias("run_start"), F.max(start).alias("run_end")
    )
    best = F.max(F.struct("run_length", (-F.col("run_start")).alias("_early"), run, "run_start", "run_end"))
    return lengths.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, f"_b.{run}", "_b.run_length", "_b.run_start", "_b.run_end"
    )
