"""Language-model scores from a sharded Elias-Fano n-gram trie.

Documents are read once into stored chunks of word ids.  A chunk sends each different word and each different n-gram, with its count in training
documents, to the shard that its context's hash names.  A shard merges what all chunks send into a trie level: contexts, monotone pointers
to their successors, and the successors, told apart by the word's hash within the context, all in Elias-Fano form, with the
discounted probabilities quantised to a byte.  The level is mapped from an unlinked file and asked for the same n-grams by successor search
relative to the context; the answers go back to the chunks in the order of the question.  So no task holds more than a shard or a chunk.

The model interpolates absolutely discounted n-grams down to single words.  It has one event for all words not seen in training, as
the base model has, which gets the whole discount of single words.

Contexts are told by 64 bits of hash, words within a context by 40, which two words of one context share with a chance of 2^-40.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import drop_shuffles_early, text_of
from tandemtape.llm.eliasfano import EliasFano, encode
from tandemtape.llm.wordhash import MIX, WordHashes, lower_words, scrambled
from tandemtape.session import cut

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
CHILD_BITS, DISCOUNT, STEP, CODES = 40, 0.75, 0.03, 255
CHUNK_WORDS, SHARD_ROWS = 1_000_000, 400_000


def quantised(p: np.ndarray) -> np.ndarray:
    """A byte for -log10 p in steps of ``STEP``, rounded so that p never grows; 0 stands for probability 0."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(p) / STEP - 1e-9) + 1
    return np.where(p > 0, np.clip(code, 1, CODES), 0).astype(np.uint8)


#: Probability of each code.
LEVELS = np.concatenate([[0.0], 10 ** (-STEP * np.arange(CODES))])


def squeeze(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def spread(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


class Grams:
    """Different n-grams of a chunk, level by level, in the order of (context hash, word): the same from the same word ids.

    ``ids`` are the words and ends of all documents one after the other as places in the sorted ``words``; ``first`` marks the
    first of every document.
    """

    def __init__(self, words: np.ndarray, ids: np.ndarray, first: np.ndarray, order: int):
        start = int(np.searchsorted(words, START))
        history = np.where(first, start, np.concatenate([[start], ids[:-1]]))
        self.levels = []  # (context hashes, context of each n-gram, its word, n-gram of each token)
        context_hash = scrambled(words[history] * MIX)
        for k in range(2, order + 1):
            names, context = np.unique(context_hash, return_inverse=True)
            grams, of = np.unique(context.astype(np.int64) * len(words) + ids, return_inverse=True)
            self.levels.append((names, grams // len(words), grams % len(words), of))
            if k < order:
                history = np.where(first, start, np.concatenate([[start], history[:-1]]))
                context_hash = scrambled(context_hash + words[history] * MIX)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _requests(words: np.ndarray, ids: np.ndarray, first: np.ndarray, train: np.ndarray, order: int, shards: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(level, shard, contexts, successors, counts) of a chunk; successors are 40 bits under the place of the context."""
    counts = np.bincount(ids, weights=train, minlength=len(words)).astype(np.uint32)
    shard = shard_of(words, shards)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.unique(shard):
        a, b = edges[s], edges[s + 1]
        yield 1, int(s), encode(words[a:b]), b"", squeeze(counts[a:b])
    for level, (names, context, word, of) in enumerate(Grams(words, ids, first, order).levels, 2):
        counts = np.bincount(of, weights=train, minlength=len(context)).astype(np.uint32)
        shard = shard_of(names, shards)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        rows = np.searchsorted(context, edges)
        for s in np.unique(shard):
            a, b, i, j = edges[s], edges[s + 1], rows[s], rows[s + 1]
            child = ((context[i:j] - a).astype(np.uint64) << np.uint64(CHILD_BITS)) | (words[word[i:j]] >> np.uint64(64 - CHILD_BITS))
            # Words of one context come in the order of their hash, so their leading bits do, too.
            yield level, int(s), encode(names[a:b]), encode(child), squeeze(counts[i:j])


def chunks(rows: DataFrame) -> DataFrame:
    """A row per chunk: the word ids of its documents, the hashes of its words, and the documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, made = WordHashes(), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, size, made
            info = pa.Table.from_batches(docs)
            words, ids = np.unique(np.append(np.concatenate(held), START), return_inverse=True)
            listed = [{"doc_id": d, "held_out": h, "n": len(x)} for d, h, x in zip(info.column("doc_id").to_pylist(), info.column("held_out").to_pylist(), held)]
            row = [[(task << 32) + made], [squeeze(ids[:-1].astype(np.uint32))], [encode(words)], [listed]]
            held, docs, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), DOCS))], ["chunk", "a", "b", "docs"])

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                held.append(np.append(hashes.of(lower_words(text)), END))
                size += len(held[-1])
                if size >= CHUNK_WORDS:
                    docs.append(batch.slice(at, i + 1 - at).select(["doc_id", "held_out"]))
                    at = i + 1
                    yield flush()
            if at < batch.num_rows:
                docs.append(batch.slice(at).select(["doc_id", "held_out"]))
        if held:
            yield flush()

    return rows.mapInArrow(read, f"chunk long, a binary, b binary, docs {DOCS_DDL}")


def opened(a: bytes, b: bytes, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, ids, marks of first tokens and document lengths of a chunk."""
    words, ids = _all(b), spread(a, np.uint32).astype(np.int64)
    lengths = np.array([d["n"] for d in docs], np.int64)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    return words, ids, first, lengths


def requests(read: DataFrame, order: int, shards: int) -> DataFrame:
    """What every chunk asks of every shard that it meets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, a, b, docs = (batch.column(c)[row].as_py() for c in ("chunk", "a", "b", "docs"))
                words, ids, first, lengths = opened(a, b, docs)
                train = np.repeat(np.array([not d["held_out"] for d in docs]), lengths)
                out = [(chunk, *r) for r in _requests(words, ids, first, train, order, shards)]
                for start in range(0, len(out), 256):
                    columns = zip(*out[start : start + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "level", "shard", "a", "b", "c"])

    return read.mapInArrow(ask, "chunk long, level int, shard int, a binary, b binary, c binary")


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())]))
DOCS_DDL = "array<struct<doc_id: bigint, held_out: boolean, n: bigint>>"


class Level:
    """One shard's trie level, mapped from a file without a name."""

    def __init__(self, parts: list[bytes]):
        self.file = tempfile.TemporaryFile()
        self.file.write(b"".join(parts))
        self.file.flush()
        whole = np.memmap(self.file, np.uint8, "r") if sum(map(len, parts)) else np.zeros(0, np.uint8)
        edges = np.cumsum([0] + [len(p) for p in parts])
        self.parts = [whole[a:b] for a, b in zip(edges, edges[1:])]


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def _all(raw: bytes) -> np.ndarray:
    return EliasFano(_bytes(raw)).whole()


def build_words(parts: list[tuple[np.ndarray, np.ndarray]]) -> Level:
    """Words seen in training with their counts."""
    hashes, of = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    counts = np.bincount(of, weights=np.concatenate([c for _, c in parts]), minlength=len(hashes)).astype(np.uint64)
    seen = counts > 0
    return Level([encode(hashes[seen]), counts[seen].tobytes()])


def build_level(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Level:
    """Contexts, pointers, successors and quantised probabilities of one shard, from what all chunks sent."""
    seen = [(names, child[c > 0], c[c > 0]) for names, child, c in parts]
    hashes = np.unique(np.concatenate([names[np.unique((child >> np.uint64(CHILD_BITS)).astype(np.int64))] for names, child, _ in seen]))
    if not len(hashes):
        return Level([encode(hashes)] * 3 + [b"", b""])
    mask = np.uint64((1 << CHILD_BITS) - 1)
    keys = [(np.searchsorted(hashes, names[(child >> np.uint64(CHILD_BITS)).astype(np.int64)]).astype(np.uint64) << np.uint64(CHILD_BITS)) | (child & mask) for names, child, _ in seen]
    keys, of = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(of, weights=np.concatenate([c for *_, c in seen]))
    context = (keys >> np.uint64(CHILD_BITS)).astype(np.int64)
    pointers = np.searchsorted(context, np.arange(len(hashes) + 1)).astype(np.uint64)
    whole = np.add.reduceat(counts, pointers[:-1].astype(np.int64))
    left = DISCOUNT * np.diff(pointers.astype(np.int64)) / whole
    # Rounding takes mass from the n-grams only, so what is left to shorter contexts stays as it is, rounded like them.
    return Level([encode(hashes), encode(pointers), encode(keys), quantised((counts - DISCOUNT) / whole[context]).tobytes(), quantised(np.minimum(left, 1.0)).tobytes()])


def ask_level(level: Level, names: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams (0 where not seen) and of what each context leaves to shorter ones (1, the whole, where not seen)."""
    hashes, pointers, keys = (EliasFano(p) for p in level.parts[:3])
    codes, lefts = level.parts[3:]
    left, code = np.ones(len(names), np.uint8), np.zeros(len(child), np.uint8)
    if not hashes.n:
        return code, left
    at = hashes.successor(names)
    known = at < hashes.n
    known[known] = hashes.access(at[known]) == names[known]
    left[known] = lefts[at[known]]
    mine = (child >> np.uint64(CHILD_BITS)).astype(np.int64)
    some = np.flatnonzero(known[mine])
    base = at[mine[some]]
    wanted = (base.astype(np.uint64) << np.uint64(CHILD_BITS)) | (child[some] & np.uint64((1 << CHILD_BITS) - 1))
    found = keys.successor(wanted)
    inside = found < pointers.access(base + 1).astype(np.int64)
    some, wanted, found = some[inside], wanted[inside], found[inside]
    same = keys.access(found) == wanted
    code[some[same]] = codes[found[same]]
    return code, left


def answers(asked: DataFrame) -> DataFrame:
    """Every shard's trie, built and asked in the task that holds its requests; also one row of level 0 with the words' totals."""

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        out, kind = [], int(rows["level"].iloc[0])
        counts = [spread(c, np.uint32) for c in rows["c"]]
        if kind == 1:
            names = [_all(a) for a in rows["a"]]
            level = build_words(list(zip(names, counts)))
            words, stored = EliasFano(level.parts[0]), np.frombuffer(level.parts[1], np.uint64)
            out.append((-1, 0, 0, np.array([stored.sum(), len(stored), (stored == 1).sum(), (stored == 2).sum()], np.int64).tobytes(), b""))
            for chunk, shard, h in zip(rows["chunk"], rows["shard"], names):
                at = words.successor(h)
                hit = at < words.n
                hit[hit] = words.access(at[hit]) == h[hit]
                reply = np.zeros(len(h), np.uint64)
                reply[hit] = stored[at[hit]]
                out.append((chunk, 1, shard, squeeze(reply), b""))
        else:
            names, child = [_all(a) for a in rows["a"]], [_all(b) for b in rows["b"]]
            level = build_level(list(zip(names, child, counts)))
            for chunk, shard, h, w in zip(rows["chunk"], rows["shard"], names, child):
                code, left = ask_level(level, h, w)
                out.append((chunk, kind, shard, squeeze(code), squeeze(left)))
        return pd.DataFrame(out, columns=["chunk", "level", "shard", "a", "b"])

    return asked.groupBy("level", "shard").applyInPandas(serve, "chunk long, level int, shard int, a binary, b binary")


def score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are runs of characters other than the blank and the controls 9 to 13, with A-Z lower-cased, and one end.  Rows whose
    crc32(doc_id) leaves ``held`` modulo ``folds`` are not learnt from.  A null text is empty and scored as an end alone; a null
    doc_id counts as the empty id; repeated rows are learnt and scored as rows like others; an empty table gives an empty table.
    Columns besides doc_id and text are not read.
    """
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_of("text").cast("binary").alias("text"))
    drop_shuffles_early(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(4, -(-size // (8 * SHARD_ROWS)))
    read = cut(chunks(rows))
    replies = cut(answers(requests(read, order, shards)))
    totals = np.zeros(4, np.int64)
    for row in replies.where(F.col("chunk") == -1).select("a").toLocalIterator():  # four numbers a shard
        totals += np.frombuffer(row["a"], np.int64)
    tokens, distinct, once, twice = (int(t) for t in totals)
    discount = once / (once + 2 * twice) if twice else 0.5

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        info = left["docs"].iloc[0]
        words, ids, first, lengths = opened(left["a"].iloc[0], left["b"].iloc[0], info)
        edges = np.cumsum(lengths) - lengths
        right = right.sort_values(["level", "shard"])
        mine = right[right["level"] == 1]
        counts = np.concatenate([spread(a, np.uint64) for a in mine["a"]]).astype(np.float64)
        if tokens:
            p = np.where(counts > 0, (counts - discount) / tokens, max(discount * distinct / tokens, 1e-12))
        else:
            p = np.ones(len(counts))
        base = np.log10((counts + 1) / (tokens + distinct + 1))
        p = p[ids]
        for k, (_, context, _, of) in enumerate(Grams(words, ids, first, order).levels, 2):
            mine = right[right["level"] == k]
            code = np.concatenate([spread(a, np.uint8) for a in mine["a"]])
            rest = np.concatenate([spread(b, np.uint8) for b in mine["b"]])
            p = LEVELS[code[of]] + LEVELS[rest[context[of]]] * p
        sums = lambda v: np.add.reduceat(v, edges)
        return pd.DataFrame(
            {
                "doc_id": pd.array([d["doc_id"] for d in info], "Int64"), "held_out": [d["held_out"] for d in info], "n_tokens": lengths,
                "n_known": sums((counts[ids] > 0).astype(np.int64)), "train_tokens": np.full(len(info), tokens, np.int64),
                "base_score": sums(base[ids]), "score": sums(np.log10(p)),
            }
        )

    whole = read.withColumnRenamed("chunk", "_chunk")
    parts = replies.where(F.col("chunk") >= 0).select("chunk", "level", "shard", "a", "b")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("_chunk").cogroup(parts.groupBy("chunk")).applyInPandas(finish, schema)
