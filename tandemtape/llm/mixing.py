"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: its weight over training time, given by knots (time, weight) and linear between them.
The integral of the schedule is the source's cumulative demand for words.  Documents of a source stand in a fixed pseudo-random
order; the words before a document are the demand at which it is due, and inverting the integral at that demand gives its position
in training.  Sorting by position yields the curriculum, and a walk through it in that order gives the words that each use takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.llm.common import WORD, drop_shuffles_early, running, text_of, word_count
from tandemtape.session import cut

#: Schedules by the rank of the source, repeating: falling, rising, even.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Words that each source gives: in proportion to the weights, at most ``most`` times its size, the excess reshared.

    Sorted by size over weight, the sources that stop at their limit come first.  The level of the others is what is left over
    their weights, so one pass over running sums replaces the rounds of resharing.  ``sources`` has a row per source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    stopped = F.col("level") * F.col("weight") > F.col("limit")
    first = F.min(F.when(~stopped, F.struct(F.col("limit") / F.col("weight"), "source_key", "level"))).over(everything)
    level = first["level"]
    return leveled.select(
        "source_key", "source_size", "rank",
        F.when(level.isNull() | stopped, F.col("limit")).otherwise(level * F.col("weight")).alias("target"),
    )


def due(demand: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Time at which the source's cumulative demand, as a share of all its demand, reaches ``demand``."""
    branches = None
    for i, knots in enumerate(schedules):
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        reached, time = 0.0, None
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            w0, w1 = w0 / whole, w1 / whole
            rest = F.greatest(demand - F.lit(reached), F.lit(0.0))
            inner = F.greatest(F.lit(w0 * w0) + F.lit(2.0 * (w1 - w0) / (t1 - t0)) * rest, F.lit(0.0))
            pieces.append((reached, F.least(F.lit(t0) + rest * 2.0 / (F.lit(w0) + F.sqrt(inner)), F.lit(t1))))
            reached += (t1 - t0) * (w0 + w1) / 2
        for start, formula in pieces:
            time = formula if time is None else F.when(demand >= F.lit(start), formula).otherwise(time)
        chosen = rank % len(schedules) == i
        branches = F.when(chosen, time) if branches is None else branches.when(chosen, time)
    return branches


ADDED = ("size", "source_size", "target", "taken", "first_words", "second_words", "first_position", "second_position")


def plan_mix(docs: DataFrame, keep: Sequence[str] | None = None, **options) -> DataFrame:
    """Every row with size, source_size, target, taken, first_words, second_words and the positions of both uses.

    The mix walks through a source's documents once, then again, until its target is met: ``first_words`` and ``second_words`` are
    the words taken in each pass, ``taken`` their sum.  Only the document at which the target is met is taken in part, so a
    source gives its target rounded down, and no document more than twice its size.  The order within a source is by a hash of
    doc_id, then by size and text, so reruns agree whatever the partitioning.  A null or empty text has size 0 and takes nothing,
    a null source is a source of its own, a null doc_id sorts as an id of its own, repeated rows are rows like others.  An empty
    table gives an empty table.  ``keep`` names the columns to carry (all by default); those that bear a name added here are
    replaced.
    """
    keep = list(docs.columns if keep is None else keep)
    placed = _place(docs, keep, **options)
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in keep if c not in ADDED], *ADDED)


def _place(docs: DataFrame, keep: Sequence[str], weights=(3, 1, 2), share=1.5, most=2.0, schedules=SCHEDULES, words_per_part=200_000):
    """``_row`` with the kept columns, and the columns in ADDED."""
    drop_shuffles_early(docs.sparkSession)
    base = cut(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
            F.monotonically_increasing_id().alias("_id"),
            source_key(F.col("source")).alias("_key"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_digest"),
            F.xxhash64(text_of("text")).alias("_tie"),
            word_count("text").alias("size"),
        )
    )
    sources = cut(base.groupBy(F.col("_key").alias("source_key")).agg(F.sum("size").alias("source_size")))
    # The largest source decides how fine the pieces are.
    largest, digits = sources.agg(F.max("source_size")).first()[0] or 0, 2
    while 16**digits * words_per_part < largest and digits < 8:
        digits += 1
    aimed = targets(sources, weights, share, most).withColumnRenamed("source_key", "_key")
    slim = base.select("_id", "_key", "_digest", "_tie", "size").withColumn("_part", F.substring("_digest", 1, digits))
    started = running(slim, ["_key"], "_part", [F.col(c) for c in ("_digest", "size", "_tie")], "size", "_start").join(aimed, "_key")
    passes = [F.struct(F.lit(k).alias("nth"), (F.col("_start") + k * F.col("source_size")).alias("start")) for k in (0, 1)]
    uses = started.where(F.col("size") > 0).select("_id", "_key", "size", "target", "rank", F.explode(F.array(*passes)).alias("u")).select("*", "u.nth", "u.start")
    for name, demand in (("at", F.col("start")), ("ends", F.col("start") + F.col("size"))):
        uses = uses.withColumn(name, due(F.try_divide(demand, F.col("target")), F.col("rank"), schedules))
    # Training ends at time 1: what is due then or later is not used.
    uses = uses.where(F.col("at") < 1.0).withColumn("_piece", F.floor(F.col("at") * 16**digits))
    uses = cut(uses.select("_id", "_key", "size", "target", "nth", "start", "at", "ends", "_piece"))
    # In the order of training, a use that ends before is whole, the one under way then stops at the target.
    walked = running(uses, ["_key"], "_piece", [F.col("at"), F.col("start")], "size", "_given")
    partly = F.greatest(F.least(F.floor(F.col("target") + 1e-7) - F.col("_given"), F.col("size")), F.lit(0))
    walked = walked.withColumn("words", F.when(F.col("ends") < 1.0, F.col("size")).otherwise(partly).cast("long"))
    amounts = []
    for k, name in enumerate(("first", "second")):
        amounts += [F.sum(F.when(F.col("nth") == k, F.col("words"))).alias(f"{name}_words"), F.min(F.when((F.col("nth") == k) & (F.col("words") > 0), F.col("at"))).alias(f"{name}_position")]
    placed = base.join(walked.groupBy("_id").agg(*amounts), "_id", "left").join(aimed, "_key").na.fill(0, ["first_words", "second_words"])
    return placed.withColumn("taken", F.col("first_words") + F.col("second_words")).select("_row", *ADDED)


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: a row for each use of a document, sorted by position, with the columns of ``docs``.

    A use in part holds the first words taken, joined by single blanks (n_chars follows); documents that the mix does not reach
    are absent.  Odd rows are treated as in :func:`plan_mix`.
    """
    placed = _place(docs, docs.columns, **options)
    use = [F.struct(F.col(f"{k}_position").alias("at"), F.col(f"{k}_words").alias("words")) for k in ("first", "second")]
    uses = placed.withColumn("_use", F.explode(F.filter(F.array(*use), lambda u: u["words"] > 0)))
    text, partly = F.col("_row").getField("text"), F.col("_use.words") < F.col("size")
    first_words = F.slice(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_use.words").cast("int"))
    fields = {c: F.col("_row").getField(c) for c in docs.columns}
    uses = uses.withColumn("_text", F.when(partly, F.array_join(first_words, " ")).otherwise(text))
    fields["text"] = F.col("_text")
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.when(partly, F.length("_text").cast(kind)).otherwise(fields["n_chars"])
    return uses.orderBy("_use.at", F.col("_row").getField("doc_id")).select(*[v.alias(c) for c, v in fields.items()])
