"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names (capitalised words inside a sentence, unless all capitals) become typed placeholders; case and punctuation go.  Windows of
template words of the benchmark are hash-joined with windows of the documents, so a question whose numbers or names were changed
still meets its template.  The values behind the placeholders must then map consistently: within one alignment a benchmark value
may stand for one document value only.

Windows of more placeholders than words say nothing of where they come from, so they meet only where the values are equal too; an item of
under eight template words is met only by all its words and values in a row.  All windows of both sides are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import text_of
from tandemtape.session import cut

WIDTH, LEAST_RUN = 6, 8
LEAST_ID = -(2**63)
#: Units that follow a number.
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|inch(?:es)?|feet|foot|yards?|mg|g|kg|t|grams?|kilograms?|tons?|tonnes?|lbs?|oz|pounds?|ounces?|"
    "ml|l|lit(?:er|re)s?|gallons?|s|sec|seconds?|min|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?|mph|kmh|kb|mb|gb|tb|w|kw|v|a|hz"
)


def spaced(column: Column | str) -> Column:
    """Words parted by single blanks, with a unit parted from its number; ``#`` is kept free for the placeholders."""
    text = F.trim(F.regexp_replace(F.translate(text_of(column), "#", ""), r"[\s ]+", " "))
    return F.regexp_replace(text, rf"(?<=\p{{N}})(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", " ")


def templated(text: Column) -> Column:
    """The template of spaced text, word for word; words of punctuation alone become empty."""
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;)] )\p{Lu}(?=[\p{L}\p{M}'’-]*\p{Ll})[\p{L}\p{M}'’-]*", "#m")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:/]\p{N}+)*(?![\p{L}\p{N}])", "#n")
    text = F.regexp_replace(F.lower(text), rf"(?<=#n )(?:{UNITS})(?![\p{{L}}\p{{N}}])", "#u")
    return F.regexp_replace(text, r"[^\p{L}\p{N}# ]+", "")


def _value(x: Column) -> Column:
    return F.lower(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _hashed(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, _both (template word t and plain word v) and _words: hashes of the template word and of the value, and 1 for placeholders.

    The explodes of one element keep these and the spaced text from being computed anew at each use.
    """
    rows = rows.select(*keys, F.explode(F.array(spaced(text))).alias("_text"))
    both = F.arrays_zip(F.split(templated(F.col("_text")), " ").alias("t"), F.split("_text", " ").alias("v"))
    rows = rows.select(*keys, F.explode(F.array(F.filter(both, lambda x: x["t"] != ""))).alias("_both"))
    slot = lambda x: x["t"].startswith("#")
    word = lambda x: F.struct(F.xxhash64(x["t"]).alias("t"), F.when(slot(x), F.xxhash64(_value(x))).otherwise(F.xxhash64(x["t"])).alias("r"), slot(x).cast("int").alias("k"))
    return rows.select(*keys, "_both", F.explode(F.array(F.transform("_both", word))).alias("_words"))


def _run_hash(at: Column, n: int) -> Column:
    """Of ``n`` words with their values."""
    return F.xxhash64(F.lit(n), *[F.get("_words", at + i)["r"] for i in range(n)])


def _window_hash(at: Column) -> Column:
    slots = sum((F.get("_words", at + i)["k"] for i in range(1, WIDTH)), F.get("_words", at)["k"])
    return F.when(slots > WIDTH // 2, _run_hash(at, WIDTH)).otherwise(F.xxhash64(*[F.get("_words", at + i)["t"] for i in range(WIDTH)]))


def _at_all(n: int, of: Callable[[Column], Column]) -> Column:
    """``of`` every start of ``n`` words; null where the text is shorter."""
    return F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(0), F.size("_words") - n), of))


def _runs(rows: DataFrame, keys: Sequence[str], text: str, lengths: Sequence[int], windows: bool) -> DataFrame:
    """A row per run of each of the ``lengths``, with its hash h, and if wanted per window.

    A row per start comes first: hashes of a row are generated code, those inside a function of an array are interpreted.
    """
    at = F.col("_at")
    fits = lambda n, h: F.when(at <= F.size("_words") - n, h)
    hashes = [fits(n, _run_hash(at, n)) for n in lengths] + ([fits(WIDTH, _window_hash(at))] if windows else [])
    least = min([*lengths, *[WIDTH] * windows])
    rows = _hashed(rows, keys, text).where(F.size("_words") >= least)
    rows = rows.select(*keys, "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - least)).alias("_at"))
    h = F.explode(F.array(*hashes)) if len(hashes) > 1 else hashes[0]
    return rows.select(*keys, h.alias("h")).where(F.col("h").isNotNull())


def _placed_windows(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every window with its position, the number of template words, and the values behind its placeholders."""
    rows = _hashed(rows, keys, text).where(F.size("_words") >= WIDTH)
    rows = rows.select(*keys, "_both", F.size("_words").alias("n"), F.explode(_at_all(WIDTH, lambda i: F.struct(i.alias("at"), _window_hash(i).alias("h")))).alias("w"))
    slots = F.transform(F.filter(F.slice("_both", F.col("w.at") + 1, F.lit(WIDTH)), lambda x: x["t"].startswith("#")), _value)
    return rows.select(*keys, "n", F.col("w.at").alias("at"), F.col("w.h").alias("h"), slots.alias("slots"))


def _short_items(items: DataFrame) -> DataFrame:
    """item, n, slots and h, the hash of all words with their values, of the items of under ``LEAST_RUN`` template words."""
    rows = _hashed(items, ["item"], "text").withColumn("n", F.size("_words")).where(F.col("n").between(1, LEAST_RUN - 1))
    h = F.coalesce(*[F.when(F.col("n") == n, _run_hash(F.lit(0), n)) for n in range(1, LEAST_RUN)])
    slots = F.size(F.array_distinct(F.transform(F.filter("_both", lambda x: x["t"].startswith("#")), _value)))
    return rows.select("item", "n", slots.cast("long").alias("slots"), h.alias("h")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, least_run: int = 13, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs (doc_id, item_id) of a document that holds a benchmark item, with _th, the hash that tells rows of one doc_id apart.

    A pair is reported if consistent windows have a run of eight template words in common and cover ``least_share`` of the item's
    template words or a run of ``least_run`` of them.
    Columns: doc_id, _th, item_id, item_words, covered_words, longest_run, slots (values seen behind placeholders).  Null and empty
    texts hold nothing, windows of more placeholders than words and items of under eight template words (these as a whole) need equal values,
    null ids are ids of their own, repeated rows are one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LEAST_ID)).alias("item"), "text").where(F.col("text").isNotNull())
    theirs, short = cut(_placed_windows(items, ["item"], "text").distinct()), cut(_short_items(items))
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # seven at most
    hashes = theirs.select("h").union(short.select("h")).distinct()
    small = hashes.count() <= broadcast_rows  # 16 bytes a row; a larger benchmark is joined by a shuffle
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("did"), F.xxhash64(text_of("text")).alias("th"), "text")
    met = _runs(rows, ["did", "th"], "text", lengths, True).join(F.broadcast(hashes) if small else hashes, "h", "left_semi").select("did", "th").distinct()
    met = cut(met)
    rows = rows.join(met, ["did", "th"], "left_semi")
    ours = _placed_windows(rows, ["did", "th"], "text").select("did", "th", "h", F.col("at").alias("mine"), F.col("slots").alias("values")).distinct()
    side = F.broadcast(theirs) if small and theirs.count() <= broadcast_rows else theirs
    # Where the values are equal anyway, a capital may make a placeholder on one side only.
    values = F.when(F.size("slots") > WIDTH // 2, F.col("slots")).otherwise(F.col("values"))
    meets = ours.join(side, "h").select("did", "th", "item", "n", "at", (F.col("mine") - F.col("at")).alias("shift"), F.arrays_zip(F.col("slots").alias("b"), values.alias("d")).alias("pairs"))
    # One alignment has at most as many rows as the item has words.
    aligned = meets.groupBy("did", "th", "item", "n", "shift").agg(F.collect_set("at").alias("ats"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    aligned = aligned.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))))
    whole = aligned.groupBy("did", "th", "item", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"), F.sum(F.size("pairs")).cast("long").alias("slots"))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("covered"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, at: Column) -> Column:
        joined = state["end"] >= at
        more = F.lit(WIDTH) - F.when(joined, state["end"] - at).otherwise(F.lit(0))
        run = F.when(joined, state["run"] + more).otherwise(F.lit(WIDTH))
        return F.struct((at + WIDTH).alias("end"), (state["covered"] + more).alias("covered"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    whole = whole.withColumn("c", F.aggregate("ats", zero, step))
    found = whole.where(F.col("c.best") >= LEAST_RUN)
    found = found.where((F.col("c.covered") >= F.lit(least_share) * F.col("n")) | (F.col("c.best") >= least_run))
    found = found.select("did", "th", "item", "n", F.col("c.covered").alias("covered"), F.col("c.best").alias("best"), "slots")
    if lengths:
        runs = _runs(rows, ["did", "th"], "text", lengths, False).distinct()
        exact = runs.join(F.broadcast(short) if small else short, "h").select("did", "th", "item", "n", F.col("n").alias("covered"), F.col("n").alias("best"), "slots")
        found = found.unionByName(exact.distinct())
    back = lambda c: F.when(F.col(c) != LEAST_ID, F.col(c))
    return found.select(
        back("did").alias("doc_id"), F.col("th").alias("_th"), back("item").alias("item_id"), F.col("n").cast("long").alias("item_words"),
        F.col("covered").cast("long").alias("covered_words"), F.col("best").cast("long").alias("longest_run"), "slots",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    leaks = find_leaks(docs, benchmark, **options).select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_did"), "_th").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = keyed.withColumn("_did", F.coalesce(F.col("_row").getField("doc_id").cast("long"), F.lit(LEAST_ID))).withColumn("_th", F.xxhash64(text_of(F.col("_row").getField("text"))))
    return keyed.join(leaks, ["_did", "_th"], "left_anti").select("_row.*")
