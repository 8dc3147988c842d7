"""Links between sets that share an entry in candidate lists, without all pairs of a group of near copies.

A list is the sets that share a token (a prefix shingle, a band).  Each set is first verified with four neighbours at most, and the links are joined into
components.  Then only pairs across components are joined in full: of a list's sets, those outside its largest
component meet all others, as far as parity sketches let them.  No link between components is lost, and a list whose sets are one component costs nothing more.

In a list of many sets the outsiders first meet hubs, a bounded number of its sets, and are tried with the nearest; so most that have a link join the
largest component before the rest is joined.  There several fine sketches of the whole sets must let a pair pass, so hardly any pair without a link is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.llm.components import components
from tandemtape.session import cut, release

#: Lists of more sets are crowded, and have about so many hubs.
CROWD, HUBS = 16, 32
#: The first bits of the hashes that each fine sketch reads, and its 64-bit words.
FINE, FINE_WORDS = (9, 19, 29, 39), 16


def shared_lists(lists: DataFrame) -> DataFrame:
    """The rows of a cut table of lists (tok, key, ...) that hold more than one set, with their size; takes the table's place."""
    sizes = lists.groupBy("tok").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = cut(lists.join(sizes, "tok"))
    release(lists.sparkSession, lists)
    return shared


def bitmap(wanted: DataFrame, bits: int) -> np.ndarray:
    """A bit per class of key; 2^bits bits for the driver, whatever the input."""
    slot = f"pmod(key, {1 << bits})"
    marks = wanted.groupBy(F.expr(f"cast(shiftright({slot}, 5) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 31 as int)))").alias("word")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[marks["at"].to_numpy()] = marks["word"].to_numpy().astype(np.uint32)
    return table


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64) have their bit set."""
    slot = (keys.view(np.uint64) & np.uint64(len(table) * 32 - 1)).astype(np.int64)
    return (table[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) > 0


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose intersection is at least ``percent`` of the union; each pair is read once."""
    of = lambda side: sets.select(F.col("key").alias(side), F.col("set").alias(f"set_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                joined = np.concatenate((x, y))
                joined.sort(kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(judge, "a long, b long")


def parity_sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Bits of 64 x ``words`` classes, each the parity of the set's hashes in the class.

    Two sketches differ in no more bits than the sets differ in elements, which bounds the intersection from above.
    """
    return np.packbits((np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fine_sketches(sets: DataFrame) -> DataFrame:
    """key and fine: one parity sketch after the other, each of other bits of the hashes, of stored sets (key, set)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("set")]
            made = np.concatenate([parity_sketch(s >> np.uint64(k), FINE_WORDS) for s in sets for k in FINE])
            ends = np.arange(0, len(made) + 1, FINE_WORDS * len(FINE), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(made))], ["key", "fine"])

    return sets.select("key", "set").mapInArrow(read, "key long, fine array<long>")


def _allowed(apart: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough with so many elements apart."""
    both = F.col("x.sn") + F.col("y.sn")
    return (100 + percent) * (both - apart) >= 2 * percent * both


def _sketches_allow(words: int, percent: int) -> Column:
    return _allowed(sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(1, words)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0")))), percent)


def _finely_apart() -> Column:
    """The most bits in which any of the fine sketches differ; no two sets with more elements apart pass for closer than that."""
    part = lambda side, i: F.slice(F.col(f"{side}.fine"), i * FINE_WORDS + 1, FINE_WORDS)
    bits = lambda p, q: F.bit_count(p.bitwiseXOR(q))
    return F.greatest(*[F.aggregate(F.zip_with(part("x", i), part("y", i), bits), F.lit(0), lambda n, m: n + m) for i in range(len(FINE))])


def _neighbours(lists: DataFrame, columns: list[str], can_link: Callable, part_rows: int, other: Callable, order: list | None = None) -> DataFrame:
    """At most one pair per set: with ``other`` (a function of the window) in the first of its lists where the filter lets it pass.

    Lists are cut into pieces of about ``part_rows`` rows by the key, so no window holds a whole long list.
    """
    parted = lists.withColumn("_part", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / F.lit(part_rows))))
    mine = F.struct("key", *columns)
    paired = parted.select("tok", mine.alias("x"), other(mine, Window.partitionBy("tok", "_part").orderBy(*(order or [*columns, "key"]))).alias("y"))
    paired = paired.where(F.col("y").isNotNull() & (F.col("x.key") != F.col("y.key")) & can_link("x", "y"))
    best = paired.groupBy(F.col("x.key").alias("a")).agg(F.min_by(F.col("y.key"), F.struct("tok", "y.key")).alias("b"))
    return best


def components_of(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with c, the component of key."""
    named = components(links).withColumnRenamed("node", "key")
    return rows.join(named, "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")


def _in_several(placed: DataFrame) -> DataFrame:
    """The rows of lists (tok, key, c, ...) whose sets lie in several components, with main, the largest of these."""
    parts = placed.groupBy("tok", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("tok")
    mixed = parts.agg(F.max(F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") > 1)
    return placed.join(mixed.select("tok", F.col("main.c").alias("main")), "tok")


def links_of(lists: DataFrame, sets_of: Callable[[DataFrame], DataFrame], sketches: DataFrame, words: int, percent: int, columns: list[str], can_link: Callable[[str, str], Column], part_rows: int = 2_000) -> DataFrame:
    """Links (a, b) that join all sets which true links join, from stored lists (tok, key, size and the filter's ``columns``).

    ``sets_of`` gives key and set for a table of keys; ``sketches`` has key, sn (elements) and the ``words`` of a parity sketch.
    """
    spark, kept = lists.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(cut(df))
        return kept[-1]

    def once(pairs: DataFrame) -> DataFrame:
        return keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()

    # Rows x and y of one list, in two components, that no filter keeps apart.
    coarse = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.c") != F.col("y.c")) & can_link("x", "y") & _sketches_allow(words, percent)
    fine = coarse & _allowed(_finely_apart(), percent)

    def met(rows: DataFrame, by: Column) -> DataFrame:
        both = rows.where(F.col("c") != F.col("main")).alias("x").join(rows.alias("y"), by)
        return once(both.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))

    first, last = (lambda row, w: F.first(row).over(w)), (lambda row, w: F.lag(row).over(w))
    tries = _neighbours(lists, columns, can_link, part_rows, first)
    for order in (None, [F.xxhash64("key", F.lit(1))], [F.xxhash64("key", F.lit(2))]):
        tries = tries.unionByName(_neighbours(lists, columns, can_link, part_rows, last, order))
    tries = once(tries)
    links = keep(verified(tries, sets_of(keep(ends(tries))), percent))

    placed = cut(components_of(lists, links))
    across = keep(_in_several(placed).join(sketches, "key"))
    release(spark, placed)
    crowded, few = across.where(F.col("size") > CROWD), met(across.where(F.col("size") <= CROWD), coarse)
    # A set of a crowded list is wanted if any of another component may link with it.
    wanted = crowded.alias("x").join(crowded.alias("y"), coarse, "left_semi").select("key")
    sets = keep(sets_of(keep(ends(few).unionByName(wanted).distinct())))
    crowded = keep(crowded.join(fine_sketches(sets), "key"))

    # Outsiders are tried with the nearest hub of the largest component and of the others, which leaves few outsiders with links.
    hubs = crowded.where(F.pmod(F.xxhash64("key", "tok"), F.ceil(F.col("size") / F.lit(HUBS))) == 0)
    near = crowded.where(F.col("c") != F.col("main")).alias("x").join(hubs.alias("y"), fine)
    near = near.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), (F.col("y.c") == F.col("y.main")).alias("large"), _finely_apart().alias("apart"))
    near = once(near.groupBy("a", "large").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
    links = keep(links.unionByName(verified(near, sets, percent)))

    crowded = keep(_in_several(components_of(crowded.drop("c", "main"), links)))
    more = verified(once(few.unionByName(met(crowded, fine))), sets, percent)
    whole = cut(links.unionByName(more))
    release(spark, *kept)
    return whole
