"""Set similarity join on word shingles: rare-first prefixes with length, positional and suffix filters.

Shingles are ordered from rare to frequent, by the count of their hash class over all documents and then by hash.  Two sets that are
similar enough share a shingle in their prefixes, so only prefix shingles are joined.  At the first shingle that a pair shares, the
sizes, the positions and the numbers of later shingles in each of four hash classes bound the intersection; pairs that cannot reach
the threshold go.  A pair is verified once, on whole sets.

Equal sets are one set before anything is joined, and near copies are linked without all their pairs (see ``linking``).

Whole sets are not stored for all documents.  They are read anew from the texts of documents in a pair to be verified; a bitmap of
fixed size spares most of the others, and a join removes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import WORD, drop_shuffles_early, small_batches, text_of
from tandemtape.llm.linking import bitmap, components_of, links_of, marked, parity_sketch, shared_lists
from tandemtape.llm.wordhash import MIX, WordHashes, lower_words, scrambled
from tandemtape.session import cut, release

LEAST_ID = -(2**63)
SKETCH = [f"w{i}" for i in range(8)]
#: Texts whose words are hashed together.
SLICE = 200


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Different hashes of the word runs of a width; of a shorter text one hash of the whole."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return different(_run_hashes(hashes, min(width, len(hashes))))


def _run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the run of words that begins at each place."""
    runs = len(hashes) - width + 1
    value = np.full(runs, np.uint64(width), np.uint64)
    for k in range(width):
        value = scrambled(value * MIX + hashes[k : k + runs])
    return value


def different(values: np.ndarray) -> np.ndarray:
    """The different values in order."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def _sets_of(batch: pa.RecordBatch, words: WordHashes, width: int) -> tuple[list[np.ndarray], list[int]]:
    """The set of every text, and a 64-bit number of it, which equal sets share."""
    hashes = [words.of(lower_words(t)) for t in batch.column("text").to_pylist()]
    # Runs of texts that are long enough are hashed in one go; those that reach into the next text are left out.
    long = [h for h in hashes if len(h) >= width]
    runs = iter(np.split(_run_hashes(np.concatenate([*long, np.zeros(width, np.uint64)]), width), np.cumsum([len(h) for h in long])))
    sets = [different(next(runs)[: len(h) - width + 1]) if len(h) >= width else shingles(h, width) for h in hashes]
    return sets, [xxhash.xxh3_64_intdigest(s) - 2**63 for s in sets]


def survey(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """One pass over did and text: did, th, n, key and sketch for every row, and for every task the counts (class, n) of its shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHashes(), np.zeros(1 << bits, np.int64)
        names = ["did", "th", "n", "key", "class", *SKETCH]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                b = batch.slice(start, SLICE)
                sets, numbers = _sets_of(b, words, width)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))
                own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(numbers, pa.int64()), pa.nulls(len(sets), pa.int64())]
                sketches = np.stack([parity_sketch(s, len(SKETCH)) for s in sets], 1)
                yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), *own, *map(pa.array, sketches)], names)
        used = np.flatnonzero(total)
        for at in np.array_split(used, max(1, len(used) // 50_000)):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(total[at]), none, pa.array(at), *[none] * len(SKETCH)], names)

    return rows.mapInArrow(read, "did long, th long, n long, key long, class long, " + ", ".join(f"{w} long" for w in SKETCH))


def class_counts(surveyed: DataFrame, bits: int) -> np.ndarray:
    """Shingles per hash class over all documents: at most 2^bits rows of two numbers for the driver, whatever the input."""
    got = surveyed.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.int32)
    counts[got["class"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return counts


def prefixes(rows: DataFrame, counts: np.ndarray, width: int, percent: int, bits: int) -> DataFrame:
    """tok, key, place (size and position) and later (shingles after it in four hash classes) for every set's rare-first prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, words = shared.value, WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                tok, key, place, later = [], [], [], []
                sets, numbers = _sets_of(batch.slice(start, SLICE), words, width)
                for s, number in zip(sets, numbers):
                    n = len(s)
                    k = n - ceil(percent * n / 100) + 1 if n else 0
                    # The rarest k: only classes up to the k-th smallest count need sorting.
                    order = rank[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64) << 32 | np.arange(n)
                    first = s[np.sort(np.partition(order, k - 1)[:k] if 0 < k < n else order) & 0xFFFFFFFF]
                    of_class = first & np.uint64(3)
                    passed = np.cumsum(of_class[:, None] == np.arange(4, dtype=np.uint64), 0)
                    left = np.minimum(np.bincount((s & np.uint64(3)).astype(np.int64), minlength=4) - passed, 65535).astype(np.uint64)
                    tok.append(first.view(np.int64))
                    key.append(np.full(k, number, np.int64))
                    place.append((np.int64(n) << 32) | np.arange(k, dtype=np.int64))
                    later.append((left @ np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tok, key, place, later)], ["tok", "key", "place", "later"])

    return rows.mapInArrow(read, "tok long, key long, place long, later long")


def whole_sets(rows: DataFrame, every: DataFrame, wanted: DataFrame, width: int, bits: int = 23) -> DataFrame:
    """key and set, as bytes, of the sets whose key is in ``wanted`` (key).  The bitmap is 2^bits bits, whatever the input.

    ``every`` (key, th) names a text of each key, so only texts whose hash is marked are cut into shingles.
    """
    texts = every.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("th").alias("th"))
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(texts.select(F.col("th").alias("key")), bits))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            batch = batch.filter(pa.array(marked(shared.value, batch.column("th").to_numpy())))
            for start in range(0, batch.num_rows, SLICE):
                sets, numbers = _sets_of(batch.slice(start, SLICE), words, width)
                at = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in at], pa.int64()), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["key", "set"])

    return rows.mapInArrow(read, "key long, set binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _can_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filter at a shared prefix shingle; passed by any linked pair at its first one."""
    n = lambda side: F.shiftright(F.col(f"{side}.place"), 32)
    after = lambda side: n(side) - F.col(f"{side}.place").bitwiseAND(0xFFFFFFFF)
    part = lambda side, i: F.shiftright(F.col(f"{side}.later"), 16 * i).bitwiseAND(65535)
    enough = lambda common: (100 + percent) * common >= percent * (n(a) + n(b))
    suffix = F.lit(1) + sum((F.least(part(a, i), part(b, i)) for i in range(1, 4)), F.least(part(a, 0), part(b, 0)))
    # Numbers of later shingles are kept up to 65535 only, so sets that large skip the suffix filter.
    fits = F.greatest(n(a), n(b)) > 65535
    return (100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b))) & enough(F.least(after(a), after(b))) & (fits | enough(suffix))


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id for every row: the smallest doc_id reachable by links, its own included.

    A set is the different runs of ``width`` words (one run of all words where there are fewer).  Two rows are linked if the
    intersection of their sets is at least ``percent`` of the union.  Null and empty texts have no shingle and are linked with
    nothing.  Rows with equal sets are linked whatever their ids; repeated rows and null ids are rows like others, and a component
    of null ids only has a null component_id.  Columns besides doc_id and text are not read.
    """
    named = _grouped(docs, **options)
    least = named.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("did").alias("component_id"))
    named = named.join(least, "c", "left")
    return named.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("did")).otherwise(F.col("component_id")).alias("component_id"))


def _grouped(docs: DataFrame, **options) -> DataFrame:
    """did, th (text hash), n and c, the component's number (null without words), for every row, as a cut table."""
    with small_batches(docs.sparkSession):
        return _joined(docs, **options)


def _joined(docs: DataFrame, width: int = 4, percent: int = 85, part_rows: int = 2_000, class_bits: int = 20) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64(text_of("text")).alias("th"), text_of("text").cast("binary").alias("text"))
    drop_shuffles_early(docs.sparkSession)
    surveyed = cut(survey(rows, width, class_bits))
    counts = class_counts(surveyed, class_bits)
    every = surveyed.where(F.col("class").isNull()).select("did", "th", "n", "key")
    # Copies have equal lists; a partial aggregate in each task takes them out before the shuffle.
    lists = cut(prefixes(rows, counts, width, percent, class_bits).groupBy("tok", "key").agg(F.first("place").alias("place"), F.first("later").alias("later")))
    lists = shared_lists(lists)  # a shingle of one set links nothing
    sketches = surveyed.where(F.col("class").isNull()).groupBy("key").agg(F.first("n").alias("sn"), *[F.first(w).alias(w) for w in SKETCH])
    links = links_of(lists, lambda wanted: whole_sets(rows, every, wanted, width), sketches, len(SKETCH), percent, ["place", "later"], lambda a, b: _can_link(a, b, percent), part_rows)
    grouped = cut(components_of(every.withColumn("key", F.when(F.col("n") > 0, F.col("key"))), links))
    release(docs.sparkSession, surveyed, lists, links)
    return grouped


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of every component, with all columns: the one with the smallest doc_id (null last), of rows that share it the one with
    the smallest text hash, of repeated rows one.  Rows without words are all kept, as they are linked with nothing."""
    grouped = _grouped(docs, **options).where(F.col("n") > 0)
    stay = grouped.groupBy("c").agg(F.min(F.struct(F.col("did").isNull().alias("none"), "did", "th")).alias("s")).select(F.coalesce("s.did", F.lit(LEAST_ID)).alias("_did"), F.col("s.th").alias("_th"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_did"), F.xxhash64(text_of("text")).alias("_th"))
    has_words = F.col("_row").getField("text").isNotNull() & F.col("_row").getField("text").rlike(WORD)
    kept = keyed.where(has_words).join(stay, ["_did", "_th"], "left_semi").dropDuplicates(["_did", "_th"])
    return kept.unionByName(keyed.where(~has_words)).select("_row.*")
