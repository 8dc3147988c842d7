"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

A chunk of documents makes one stripe per prefix it holds, stripes of a prefix are merged elementwise, and the merged structure gives
the count of every extension, the totals of the prefixes one word shorter (entries of the stripes before) and, by maxima over the
entries, which phrases a longer one subsumes.  The stripe of the empty prefix is the table of words.

Documents are read once into stored chunks of word ids; each length is one pass over the chunks.  A phrase is frequent only if
both phrases one word shorter inside it are, so other windows make no entry.  Bit tables sized from the counted keys, at most
2^``MOST_BITS`` bits, tell which are frequent; a full table lets more through and changes no count.  The stripes of prefixes that begin with a hot word are sliced by the next word,
so no task merges a whole hot stripe; at most 1,024 words can hold a thousandth of all, and only they are sent to tasks.

Words of a language are told by 64 bits of hash; two frequent words with one hash stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemtape.llm.common import drop_shuffles_early, text_of
from tandemtape.llm.linking import bitmap, marked
from tandemtape.llm.ngramtrie import spread, squeeze
from tandemtape.llm.wordhash import MIX, scrambled
from tandemtape.session import cut, release

#: Pieces end at these bytes; a tab parts words as a blank does.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PARTS = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
CHUNK_WORDS = 2_000_000
MOST_BITS, HOT_SHARE = 27, 1024
TURN = 23


class Places(dict):
    """The places of one language's words in the list of a chunk's words; a word gets its place when it is first met."""

    def __init__(self, lang: bytes, words: list[tuple[bytes, bytes]]):
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.words)
        self.words.append((self.lang, word))
        return place


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece that has any."""
    return filter(None, (piece.split() for piece in text.lower().translate(PARTS).split(b"\n")))


ENTRY = "array<struct<lang:binary,word:binary,id:bigint,c:bigint>>"
ENDS = np.uint32(1 << 31)


def _chunks(docs: DataFrame) -> DataFrame:
    """A row per chunk of about ``CHUNK_WORDS`` words: its words with their hashes and counts, and its text as places in them.

    The top bit of a place says that a piece ends with it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, Places] = {}
        words: list[tuple[bytes, bytes]] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            seq = np.concatenate(held)
            counts = np.bincount(seq & ~ENDS, minlength=len(words)).astype(np.int64)
            seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in places}
            ids = pa.array(np.fromiter((xxhash.xxh64_intdigest(word, seed=seeds[lang]) for lang, word in words), np.uint64, len(words)).view(np.int64))
            lang, word = (pa.array(column, pa.binary()) for column in zip(*words))
            entries = pa.StructArray.from_arrays([lang, word, ids, pa.array(counts)], ["lang", "word", "id", "c"])
            whole = pa.array(np.array([0, len(words)], np.int32))
            return pa.RecordBatch.from_arrays([pa.array([squeeze(seq)], pa.binary()), pa.ListArray.from_arrays(whole, entries)], ["seq", "entries"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in places:
                    places[lang] = Places(lang, words)
                place_of = places[lang].__getitem__
                found: list[int] = []
                ends: list[int] = []
                for piece in pieces(text):
                    found.extend(map(place_of, piece))
                    ends.append(len(found) - 1)
                if found:
                    seq = np.array(found, np.uint32)
                    seq[ends] |= ENDS
                    held.append(seq)
                    size += len(found)
                if size >= CHUNK_WORDS:
                    yield flush()
                    places, words, held, size = {}, [], [], 0
        if size:
            yield flush()

    return docs.mapInArrow(read, f"seq binary, entries {ENTRY}")


def _windows(ids: np.ndarray, starts: np.ndarray, length: int, hot: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The stripes of prefixes of ``length`` - 1 words over one chunk: a row per prefix and slice, its next words and their counts."""
    joints = length - 1
    prefix = ids[starts]
    for j in range(1, joints):
        prefix = scrambled(prefix + ids[starts + j] * MIX)
    _, first, count = np.unique(scrambled(prefix + ids[starts + joints] * MIX), return_index=True, return_counts=True)
    at, prefix = starts[first], prefix[first]
    following = ids[at + joints]
    hot_ids, hot_slices = hot
    place = np.minimum(np.searchsorted(hot_ids, ids[at]), max(len(hot_ids) - 1, 0))
    slices = np.where(hot_ids[place] == ids[at], hot_slices[place], 1) if len(hot_ids) else np.ones(len(at), np.uint64)
    part = (following >> np.uint64(7)) % slices.astype(np.uint64)
    order = np.lexsort((part, prefix))
    at, prefix, part, following, count = (x[order] for x in (at, prefix, part, following, count))
    new = np.ones(len(at), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
    edges = np.flatnonzero(new)
    offsets = pa.array(np.append(edges, len(at)).astype(np.int32))
    words = ids[at[edges][:, None] + np.arange(joints)].view(np.int64).ravel()
    columns = [
        pa.ListArray.from_arrays(pa.array(np.arange(0, joints * len(edges) + 1, joints, dtype=np.int32)), pa.array(words)),
        pa.array(part[edges].astype(np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(following.view(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["prefix", "part", "next", "count"])


def turned(key: np.ndarray) -> np.ndarray:
    return (key << np.uint64(TURN)) | (key >> np.uint64(64 - TURN))


def phrase_key(ids: Column) -> Column:
    """The key of a phrase in the bit table: its hashes, each turned once for every word behind it."""
    turn = lambda key: F.shiftleft(key, TURN).bitwiseOR(F.shiftrightunsigned(key, 64 - TURN))
    return F.aggregate(ids, F.lit(0).cast("long"), lambda key, word: turn(key).bitwiseXOR(word))


def _stripes(chunks: DataFrame, length: int, frequent: Broadcast, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Stripes of all chunks for phrases of ``length`` words, of which both shorter phrases inside are marked ``frequent``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            for words, seq in zip(batch.column("ids"), batch.column("seq")):
                seq = spread(seq.as_py(), np.uint32)
                ids = words.values.to_numpy().view(np.uint64)[seq & ~ENDS]
                n = len(ids) - length + 1
                if n < 1:
                    continue
                follows, key = seq < ENDS, ids
                for j in range(1, length - 1):
                    key = turned(key[:-1]) ^ ids[j:]
                known = marked(table, key)
                good = reduce(np.logical_and, [follows[j : n + j] for j in range(length - 1)], known[:n] & known[1 : n + 1])
                made = _windows(ids, np.flatnonzero(good), length, hot)
                for start in range(0, made.num_rows, 20_000):
                    yield made.slice(start, 20_000)

    return chunks.select(F.col("entries.id").alias("ids"), "seq").mapInArrow(read, "prefix array<long>, part int, next array<long>, count array<long>")


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of one prefix and slice merged elementwise; entries of at least ``least`` as (ids, f)."""
    met = stripes.repartition("prefix", "part")
    entries = met.select("prefix", "part", "count", F.posexplode("next").alias("at", "next"))
    entries = entries.select("prefix", "part", "next", F.col("count")[F.col("at")].alias("c"))
    summed = entries.groupBy("prefix", "part", "next").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    return summed.select(F.concat("prefix", F.array("next")).alias("ids"), "f")


def _bits_for(keys: int) -> int:
    """Sixteen bits a key, between 2^16 and 2^``MOST_BITS``."""
    return min(max(16, (16 * keys).bit_length()), MOST_BITS)


def _stored_small(df: DataFrame) -> DataFrame:
    """``df`` cut under a codec that packs word lists well; the session's own setting holds again afterwards."""
    conf, name = df.sparkSession.conf, "spark.sql.parquet.compression.codec"
    usual = conf.get(name)
    conf.set(name, "zstd")
    try:
        return cut(df)
    finally:
        conf.set(name, usual)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``a`` >= ``least`` times; cut after its first words it has l and r occurrences of its parts, and scores
    floor(1000 * a * n / (l * r)) with n words in the language; its lowest cut counts.  Phrases inside a longer frequent phrase with
    100 * f(longer) >= ``covered`` * a are left out.

    ``docs`` has lang and text; other columns are ignored.  No lang: ``und``; no text or an empty one: no words.  Repeated rows count as
    often as they occur.  No rows: no rows.  Ties: higher a, then the phrase by its bytes.  Runs jobs when called.
    """
    spark = docs.sparkSession
    drop_shuffles_early(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), text_of("text").cast("binary").alias("text"))
    chunks = _stored_small(_chunks(docs))
    entries = chunks.select(F.inline("entries"))
    totals = cut(entries.groupBy("lang").agg(F.sum("c").alias("n")))
    words = cut(entries.groupBy("lang", "word", "id").agg(F.sum("c").alias("f")).where(F.col("f") >= least))
    size = totals.agg(F.sum("n")).first()[0] or 0
    known = words.count()
    if words.select("id").distinct().count() < known:
        raise ValueError("two frequent words have one hash; run with other seeds")
    heavy = words.where(F.col("f") * HOT_SHARE > size).select("id", "f").toArrow()
    hot_ids = heavy["id"].to_numpy().view(np.uint64)
    hot_slices = np.exp2(np.ceil(np.log2(np.maximum(heavy["f"].to_numpy() * HOT_SHARE / max(size, 1), 1)))).astype(np.uint64)
    order = np.argsort(hot_ids)
    hot = hot_ids[order], hot_slices[order]

    by_length, shorter, count = [], words.select(F.array("id").alias("ids")), known
    for length in range(2, longest + 1):
        frequent = spark.sparkContext.broadcast(bitmap(shorter.select(phrase_key(F.col("ids")).alias("key")), _bits_for(count)))
        by_length.append(cut(_merged(_stripes(chunks, length, frequent, hot), least)))
        frequent.destroy()
        shorter, count = by_length[-1], by_length[-1].count()
    phrases = reduce(DataFrame.unionByName, by_length)

    # Maxima over the entries that hold a phrase as a part.
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), w -> transform(sequence(1, size(ids) - w + 1), i -> slice(ids, i, w))))")
    maxima = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("held"))
    kept = phrases.join(maxima, "ids", "left").where(F.col("held").isNull() | (100 * F.col("held") < covered * F.col("f")))
    kept = cut(kept.select("ids", F.col("f").alias("a")))

    lengths = words.select(F.array("id").alias("ids"), "f").unionByName(phrases)
    named = words.select("id", F.col("word").cast("string").alias("word"), "lang")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(named, "id")
    spelled = spelled.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"), F.first("lang").alias("lang"))
    spelled = spelled.select("ids", "lang", F.concat_ws(" ", F.col("ws.word")).alias("phrase"))

    cuts = kept.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"_first": F.expr("slice(ids, 1, k)"), "_rest": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = cuts.join(lengths.select(F.col("ids").alias("_first"), F.col("f").alias("l")), "_first").join(lengths.select(F.col("ids").alias("_rest"), F.col("f").alias("r")), "_rest")
    cuts = cuts.join(spelled, "ids").join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")) * wide("n")
    cuts = cuts.select("ids", "lang", "phrase", "a", "n", F.struct(F.call_function("div", above, wide("l") * wide("r")).alias("score"), "k", "l", "r").alias("at_cut"))
    scored = cuts.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min("at_cut").alias("at_cut"))
    scored = scored.select(F.col("lang").cast("string").alias("lang"), "phrase", "a", F.col("at_cut.l").alias("l"), F.col("at_cut.r").alias("r"), "n", F.col("at_cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    result = cut(scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top))
    release(spark, chunks, totals, words, kept, *by_length)
    return result.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
