"""Ordered passes whose slices hold a bounded number of rows, however their positions lie.

Slices of a fixed width of positions fail twice: ids far apart give as many slices as rows, and one dense hour gives one huge slice.
Here the rows of each key are counted in up to 1,024 ranges of positions, an overfull range is counted again in 1,024 parts, and so on;
neighbouring parts of one range are then put together up to the wanted number of rows.  A slice is named by its first
position.  Only counts are shuffled for that.

The pass itself shuffles the rows once, by key and slice.  Each slice leaves one row with its totals and its first or last values, and these
rows go through the same pass again until a key has no more of them than fit one slice: a tree of scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtape.operators.ordered import later_rows
from tandemtape.session import cut

ROWS = 1 << 18
FAN_BITS = 10

Look = Mapping[str, Column | tuple[Column, Column]]


def _on(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, nulls among them, and keep the left ones."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in columns])


def counted_slices(df: DataFrame, keys: Sequence[str], position: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_lo``, the first position of the slice of each row.

    A slice has at most twice ``rows`` rows, more only where one position alone has more.  ``df`` is read once per level: hand in a
    scan or a cut table.
    """
    keys = list(keys)
    p = F.col(position)
    most, low, high = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"))
        .agg(F.max("n"), F.min("low"), F.max("high")).first()
    )
    if most is None or most <= rows:
        return df.withColumn("_lo", F.lit(low).cast("bigint"))
    # Ranges are counted from the lowest position, so their numbers are never negative.
    offset = (p - F.lit(low)).cast("bigint")
    shift = max((high - low).bit_length() - FAN_BITS, 0)
    levels: list[tuple[int, DataFrame]] = []
    inside = df.select(*keys, offset.alias("_p"))
    while True:
        bucket = F.shiftright("_p", shift)
        counts = cut(inside.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
        full = counts.where(F.col("_n") > rows)
        last = shift == 0 or full.isEmpty()
        # Parts of one range are put together in order; a range that is split further stands alone and breaks the run.
        around = Window.partitionBy(*keys, F.shiftright("_b", FAN_BITS)).orderBy("_b")
        split = (F.col("_n") > rows) & F.lit(not last)
        run = counts.withColumn("_s", split.cast("int")).withColumn("_run", F.sum("_s").over(around.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.sum("_n").over(Window.partitionBy(*keys, F.shiftright("_b", FAN_BITS), "_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        run = run.where(~split).withColumn("_piece", F.floor(F.coalesce(before, F.lit(0)) / rows))
        lo = F.min(F.shiftleft(F.col("_b"), shift)).over(Window.partitionBy(*keys, F.shiftright("_b", FAN_BITS), "_run", "_piece"))
        levels.append((shift, run.select(*keys, "_b", (lo + F.lit(low)).alias("_lo"))))
        if last:
            break
        inside = _on(inside.withColumn("_b", bucket), full.select(*keys, "_b"), [*keys, "_b"], "left_semi").drop("_b")
        shift = max(shift - FAN_BITS, 0)
    placed = df
    for number, (shift, named) in enumerate(levels):
        at = F.shiftright(offset, shift)
        placed = _on(placed.withColumn("_b", at), named.withColumnRenamed("_lo", f"_lo{number}"), [*keys, "_b"], "left").drop("_b")
    found = [f"_lo{number}" for number in range(len(levels))]
    return placed.withColumn("_lo", F.coalesce(*found)).drop(*found)


def _boxed(looks: Look) -> dict[str, Column]:
    """Each looked-for value in a struct, null where its condition does not hold."""
    boxes = {}
    for name, spec in looks.items():
        value, where = spec if isinstance(spec, tuple) else (spec, None)
        box = F.struct(value.alias("v"))
        boxes[name] = box if where is None else F.when(where, box)
    return boxes


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, before: Look | None = None, upto: Look | None = None,
    after: Look | None = None, sums: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
    lows: Mapping[str, Column] | None = None, rows: int = ROWS,
) -> DataFrame:
    """Add order-dependent columns to each row of its key's sequence; runs jobs when called.

    ``before``: value at the latest earlier row, ``upto``: value at the latest row up to the current one, ``after``: value at the
    earliest later row; each may be a pair (value, condition).  ``sums``: running total, current included; ``totals``: over the whole
    sequence; ``lows``: least value of the later rows.  ``order`` starts with a whole number without nulls.  ``df`` is a scan or a cut table.
    """
    keys, before, upto, after = list(keys), dict(before or {}), dict(upto or {}), dict(after or {})
    sums, totals, lows = dict(sums or {}), dict(totals or {}), dict(lows or {})
    boxes = _boxed({**before, **upto, **after})
    added = {**sums, **totals}
    inside = Window.partitionBy(*keys, "_lo").orderBy(*order)
    past, present = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = later_rows([*keys, "_lo"], order)
    is_end = F.lead(F.lit(1)).over(inside).isNull()
    near = lambda n: F.last(boxes[n], True).over(rest if n in after else past if n in before else present)
    edge = lambda n: (F.first if n in after else F.last)(boxes[n], True).over(whole)
    sliced = counted_slices(df, keys, order[0], rows)
    passed = cut(sliced.select(
        *df.columns, "_lo", is_end.alias("_end"), *[near(n).alias(f"_n_{n}") for n in boxes], *[F.sum(v).over(present).alias(f"_n_{n}") for n, v in sums.items()],
        *[F.min(v).over(rest).alias(f"_n_{n}") for n, v in lows.items()], *[F.when(is_end, F.min(v).over(whole)).alias(f"_t_{n}") for n, v in lows.items()],
        *[F.when(is_end, edge(n)).alias(f"_t_{n}") for n in boxes], *[F.when(is_end, F.sum(v).over(whole)).alias(f"_t_{n}") for n, v in added.items()],
    ))
    ends = _across(passed.where("_end").select(*keys, "_lo", *[f"_t_{n}" for n in (*boxes, *added, *lows)]), keys, before, upto, after, sums, totals, lows, rows)
    met = _on(passed, ends, [*keys, "_lo"], "left")
    return met.select(
        *df.columns, *[F.coalesce(F.col(f"_n_{n}"), F.col(f"_c_{n}"))["v"].alias(n) for n in boxes],
        *[(F.coalesce(f"_n_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums], *[F.col(f"_c_{n}").alias(n) for n in totals],
        *[F.least(f"_n_{n}", f"_c_{n}").alias(n) for n in lows],
    )


def _across(ends: DataFrame, keys, before, upto, after, sums, totals, lows, rows: int) -> DataFrame:
    """What each slice takes from the others of its key: the nearest edge value on its side, the total before it, the whole total, the least later value."""
    t = lambda n: F.col(f"_t_{n}")
    many = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if many > rows:
        again = scan(
            ends.withColumnRenamed("_lo", "_at"), keys, ["_at"], before={f"_c_{n}": (t(n), t(n).isNotNull()) for n in (*before, *upto)}, after={f"_c_{n}": (t(n), t(n).isNotNull()) for n in after},
            sums={f"_c_{n}": t(n) for n in sums}, totals={f"_c_{n}": t(n) for n in totals}, lows={f"_c_{n}": t(n) for n in lows}, rows=rows,
        )
        return again.select(
            *keys, F.col("_at").alias("_lo"), *[f"_c_{n}" for n in (*before, *upto, *after, *totals, *lows)], *[(F.col(f"_c_{n}") - F.coalesce(t(n), F.lit(0))).alias(f"_c_{n}") for n in sums],
        )
    line = Window.partitionBy(*keys).orderBy("_lo")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), later_rows(keys, ["_lo"])
    return ends.select(
        *keys, "_lo", *[F.last(t(n), True).over(earlier).alias(f"_c_{n}") for n in (*before, *upto)], *[F.last(t(n), True).over(later).alias(f"_c_{n}") for n in after],
        *[F.sum(t(n)).over(earlier).alias(f"_c_{n}") for n in sums], *[F.sum(t(n)).over(Window.partitionBy(*keys)).alias(f"_c_{n}") for n in totals],
        *[F.min(t(n)).over(later).alias(f"_c_{n}") for n in lows],
    )
