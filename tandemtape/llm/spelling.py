"""Spelling variants by asymmetric q-chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced character.  The shorter word (either, if equally long) of n
characters contributes two disjoint chunks of n // 2, its head and the part after it; the other contributes its positional grams of
that size.  One edit touches one chunk at most, so the other chunk is a gram of the longer word, at its own place or one later:
a join on the chunk at these places meets every near pair, and each pair is then verified.  Grams at other places, which no chunk
of the shorter word can meet, are not made.

A chunk that very many words share makes a long list.  The untouched chunk tells which half holds the edit, so the lists are
told apart further by what one edit leaves of that half as well: its first or last quarter, by the same rule.

Tables of words are joined by sorting on both sides (``sorted_sides``).  Spark sizes a side by the compressed file it was read from, and an explode
makes many times that, so it would collect and broadcast chunks and words that do not fit the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import drop_shuffles_early, lower_ascii, text_of
from tandemtape.session import cut, release

RUN = r"[A-Za-zÀ-ÿ]+"


def sorted_sides(side: DataFrame) -> DataFrame:
    """The table as one side of a sort-merge join, whatever size Spark expects of it."""
    return side.hint("merge")


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one character, where ``every`` divides the checksum of its document and itself; else the run."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, every: int, shortest: int, least: int) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` characters that occur at least ``least`` times."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text_of("text"), F.lit(RUN), F.lit(0))).alias("run"))
    # A deletion takes one character away, so shorter runs cannot make a word.
    runs = runs.where(F.char_length("run") >= shortest).withColumn("run", lower_ascii(F.col("run")))
    words = runs.select(slipped(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _ends(rest: Column, size: Column) -> Column:
    """The two parts of a rest of which one edit leaves one: its first ``size`` characters, its last ``size``."""
    return F.array(F.struct(F.lit("f").alias("side"), F.substr(rest, F.lit(1), size).alias("part")), F.struct(F.lit("l").alias("side"), F.right(rest, size).alias("part")))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a the shorter or the smaller, of near words among the different values of ``word``."""
    sized = words.select("word", F.char_length("word").alias("m"))
    w, n = F.col("word"), F.col("n")
    half = F.floor(n / 2).cast("int")
    quarter = F.floor(half / 2).cast("int")

    def keyed(rows: DataFrame, choices: list[tuple[str, Column, Column]]) -> DataFrame:
        """A row per chunk or gram and per part of the rest: (word, m, n, place, chunk, side, part)."""
        made = F.array(*[F.struct(F.lit(place).alias("place"), chunk.alias("chunk"), rest.alias("rest")) for place, chunk, rest in choices])
        parts = rows.select("word", "m", "n", F.explode(made).alias("c"), quarter.alias("q"))
        return parts.select("word", "m", "n", "c.place", "c.chunk", F.explode(_ends(F.col("c.rest"), F.col("q"))).alias("e")).select("word", "m", "n", "place", "chunk", "e.side", "e.part")

    head, rest_of = (lambda size: F.substr(w, F.lit(1), size)), (lambda start: F.substr(w, start))
    around = lambda start: F.concat(head(start), F.substr(w, start + half + 1))  # noqa: E731  what is left and right of a gram at ``start``
    short = sized.withColumn("n", F.col("m"))
    chunks = keyed(short, [("head", head(half), rest_of(half + 1)), ("tail", F.substr(w, half + 1, half), around(half))])
    long = sized.withColumn("n", F.explode(F.array(F.col("m"), F.col("m") - 1)))
    grams = keyed(long, [("head", head(half), rest_of(half + 1)), ("tail", F.substr(w, half + 1, half), around(half)), ("tail", F.substr(w, half + 2, half), around(half + 1))])
    keys = ["n", "place", "chunk", "side", "part"]
    met = chunks.withColumnsRenamed({"word": "a", "m": "ma"}).join(sorted_sides(grams.withColumnsRenamed({"word": "b", "m": "mb"})), keys)
    met = met.where((F.col("ma") < F.col("mb")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "b").distinct()


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) for all words with a form: the last form on the way.

    Each form is at least ``ratio`` times as frequent as the word, so a way is as short as a logarithm of the largest count; each
    round doubles the steps that a row has taken.
    """
    spark, now = forms.sparkSession, cut(forms.select("word", F.col("form").alias("root")))
    longest, reach = forms.agg(F.max("form_n")).first()[0] or 1, 1
    steps = 1
    while ratio**steps <= longest:
        steps += 1
    while reach < steps:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = cut(now.join(sorted_sides(further), "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        release(spark, now)
        now, reach = then, 2 * reach
    return now


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """Every word with its commoner spelling: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of whole texts, A-Z lower-cased, after one character of a run is dropped where ``every`` divides
    the checksum of ``<doc_id>:<run>``; those of at least ``shortest`` characters and ``least`` occurrences count.  ``n_near`` words differ by
    one edit; the most frequent of them (ties: the smallest) is the form if it occurs at least ``ratio`` times as often, and the
    root is the last form on the way.

    ``docs`` has doc_id and text; other columns are ignored.  No text: no words; no doc_id: an empty one.  Repeated rows count as often as
    they occur.  No rows: no rows.  Runs jobs when called.
    """
    spark = docs.sparkSession
    drop_shuffles_early(spark)
    words = cut(vocabulary(docs, every, shortest, least))
    pairs = cut(near_words(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "word", "b": "other"})
    met = both.join(sorted_sides(words.select(F.col("word").alias("other"), F.col("n").alias("form_n"))), "other")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    judged = words.join(sorted_sides(best), "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    judged = cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    roots = _roots(judged.where(F.col("form").isNotNull()), ratio)
    result = judged.join(sorted_sides(roots), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return result.select("word", "form", "root", "n", "n_near", "form_n")
