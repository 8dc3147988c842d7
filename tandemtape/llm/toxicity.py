"""Toxicity by a subsequence string kernel, Nyström landmarks and linear support vector machines.

The kernel of two strings sums over their common subsequences of three characters, each occurrence weighted by ``DECAY`` to the
length it spans, normalised and squared, so ``idxiot`` and ``id.i.ot`` stay close to ``idiot``.  Landmarks are learned from the labels
of the training rows alone: whole words, and stems, the first four to eight letters of words with free endings.  A piece qualifies by
the number of documents that hold it: were it independent of the label, so lopsided a count would turn up among all pieces with a chance
below ``CHANCE`` (a bound of the binomial tail times the number of pieces), so that rare insults and short ones qualify too.

Words.  The Nyström map K^(-1/2) turns a word's kernels with the landmarks, and with frequent words as background, into features, and a
linear machine weighs them; a text is as toxic as its worst word.  Labels are given per document, so training is by witnesses: a
toxic document stands for those of its words that are, under the machine so far, worse than nearly all of clean documents, a clean one
for all its words nearest to the landmarks.  After each fit the witnesses are chosen anew.  A toxic document without a witness is left
out; toxic landmarks of six letters or more are added as toxic with one letter inserted (shorter ones come too near to harmless words).

Stems.  Clean texts hold a stem by chance, the longer the oftener, so it counts how many words of a text begin with it, against what
clean texts of that length hold.

A second linear machine over documents weighs the worst word and the stems; a logistic curve over its margins gives the score.

The training rows are a hash sample of about ``most_rows`` labelled documents, of which near copies count once; everything else
covers all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.llm.common import text_of
from tandemtape.session import cut

DECAY, LENGTH, WIDE, STEP = 0.75, 3, 24, 12
CACHE = 300_000
HEADS, CHANCE = range(4, 9), 0.01
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def plain(word: str) -> str:
    """Letters of a lower-cased word: signs at its ends go, lookalikes inside become letters, other signs inside go."""
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    word = word[a:b]
    if not any(c.isalpha() for c in word):
        return ""
    return "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())


def words_of(text: str) -> Counter:
    """The words of a text and how often they occur; three or more single characters in a row also count as one word (``i d i o t``)."""
    words = text.lower().split()
    found = Counter(words)
    single = np.fromiter((len(w) == 1 for w in words), bool, len(words))
    if single.sum() >= LENGTH:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= LENGTH:
                found["".join(words[a:b])] += 1
    return found


def pieces(word: str) -> list[str]:
    """A word, or overlapping pieces of one longer than ``WIDE``."""
    return [word] if len(word) <= WIDE else [word[i : i + WIDE] for i in range(0, len(word) - STEP, STEP)]


def codes(strings: list[str]) -> np.ndarray:
    return np.array(strings, dtype=f"U{WIDE}").view(np.uint32).reshape(len(strings), WIDE)


def kernel(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The kernel of every row of character codes (0 pads) with one string, or with the same row of a second array."""
    n = len(x)
    other = other.T if other.ndim == 2 else other[other != 0][:, None]
    d, many = np.float32(DECAY), len(other)
    after = np.arange(many)[:, None] - np.arange(many)[None, :] - 1
    spread = np.where(after >= 0, DECAY ** np.maximum(after, 0), 0).astype(np.float32)
    total = np.zeros(n, np.float32)
    # state[k][j]: weight of common subsequences of k + 1 characters that end before both characters, decayed up to them.
    state = [np.zeros((many, n), np.float32) for _ in range(LENGTH - 1)]
    for i in range(int((x != 0).sum(1).max(initial=0))):
        c = x[:, i]
        match = ((other == c) & (c != 0)).astype(np.float32) * (d * d)
        ends = [match] + [match * s for s in state]
        total += ends[-1].sum(0)
        for k in range(LENGTH - 1):
            state[k] *= d
            state[k] += spread @ ends[k]
    return total


class Features:
    """Squares of the normalised kernels with the landmarks.

    Values under ``FLOOR`` count as 0, and so do pairs that share under ``SHARE`` of the landmark's different letters.  A string's
    kernel with itself is at least that of its positions with themselves, so most pairs are seen to be under the floor without it.
    """

    SHARE, FLOOR = 0.6, 0.05

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = codes(landmarks)
        self.own = np.maximum(kernel(self.codes, self.codes), 1e-12)
        self.letters = [np.unique(c[c != 0]) for c in self.codes]
        spans = [sum((n - s + 1) * (s - 2) * DECAY ** (2 * s) for s in range(LENGTH, n + 1)) for n in range(WIDE + 1)]
        self.least = np.maximum(np.array(spans), 1e-12)

    def of(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        long = np.fromiter(map(len, strings), np.int64, len(strings))
        for lo, hi in ((LENGTH, 7), (8, 11), (12, 16), (17, WIDE)):
            at = np.flatnonzero((long >= lo) & (long <= hi))
            for start in range(0, len(at), 16_384):
                chunk = at[start : start + 16_384]
                x = codes([strings[i] for i in chunk])[:, :hi]
                # A bit per letter class: 64 classes by code, so a missing bit is a missing letter.
                bits = np.zeros(len(x), np.uint64)
                for i in range(hi):
                    bits |= np.where(x[:, i] != 0, np.left_shift(np.uint64(1), (x[:, i] % 64).astype(np.uint64)), np.uint64(0))
                least, raw = self.least[long[chunk]], np.zeros((len(x), len(self.landmarks)), np.float32)
                for j, letters in enumerate(self.letters):
                    shared = sum(((bits >> np.uint64(c % 64)) & np.uint64(1)).astype(np.int8) for c in letters)
                    near = np.flatnonzero(shared >= np.ceil(self.SHARE * len(letters)))
                    if len(near):
                        value = np.square(kernel(x[near], self.codes[j])) / self.own[j]
                        raw[near, j] = np.where(value >= self.FLOOR * least[near], value, 0)
                hit = np.flatnonzero(raw.any(1))
                if len(hit):
                    value = raw[hit] / np.maximum(kernel(x[hit], x[hit]), 1e-12)[:, None]
                    out[chunk[hit]] = np.where(value >= self.FLOOR, value, 0)
        return out


class Reader:
    """Kernel rows of words and stems met; with weights, the worst margin of texts.  Words met before are remembered, up to a bound."""

    def __init__(self, landmarks: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.features, self.weights = Features(landmarks) if landmarks else None, weights
        self.stems = tuple(stems)
        self.margin: dict[str, float] = {}
        self.begins: dict[str, tuple[int, ...]] = {}  # of words that begin with a stem

    def rows(self, words: list[str]) -> np.ndarray:
        """The kernels of each plain word, the largest of its pieces where it is long."""
        where: dict[str, int] = {}
        short, long = [], []
        for i, word in enumerate(words):
            if LENGTH <= len(word) <= WIDE:
                short.append((i, where.setdefault(word, len(where))))
            elif len(word) > WIDE:
                long.append((i, [where.setdefault(p, len(where)) for p in pieces(word)]))
        values = self.features.of(list(where))
        out = np.zeros((len(words), len(self.features.landmarks)), np.float32)
        if short:
            at, of = np.array(short).T
            out[at] = values[of]
        for i, of in long:
            out[i] = values[of].max(0)
        return out

    def begun(self, word: str) -> tuple[int, ...]:
        """The stems a plain word begins with."""
        return tuple(j for j, stem in enumerate(self.stems) if word.startswith(stem) and len(word) > len(stem))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the largest margin of a word (0 without words or weights), how many words begin with each stem, and how many words there are."""
        worst, hits, sizes = np.zeros(len(texts)), np.zeros((len(texts), len(self.stems))), np.zeros(len(texts))
        for batch in batched(texts):
            sets = [words_of(texts[i]) for i in batch]
            if len(self.margin) > CACHE:
                self.margin, self.begins = {}, {}
            fresh = list(set().union(*sets).difference(self.margin))
            bare = [plain(w) for w in fresh]
            self.margin.update(zip(fresh, (self.rows(bare) @ self.weights).tolist() if self.features and self.weights is not None else [0.0] * len(fresh)))
            self.begins.update((w, self.begun(b)) for w, b in zip(fresh, bare) if b.startswith(self.stems))
            for i, words in zip(batch, sets):
                sizes[i] = words.total()
                worst[i] = max(map(self.margin.__getitem__, words), default=0.0)
                for word in self.begins.keys() & words.keys():
                    for j in self.begins[word]:
                        hits[i, j] += words[word]
        return worst, hits, sizes

    def hard(self, texts: list[str], toxic: int, most: int = 6) -> list[np.ndarray]:
        """Per text the kernels of the words nearest to the first ``toxic`` landmarks."""
        if not self.features:
            return [np.zeros((1, 0), np.float32)] * len(texts)
        found = []
        for batch in batched(texts):
            sets = [sorted(words_of(texts[i])) for i in batch]
            words = sorted(set().union(*sets))
            rows, where = self.rows([plain(w) for w in words]), dict(zip(words, range(len(words))))
            near = rows[:, :toxic].max(1, initial=0)
            for own in sets:
                at = np.array([where[w] for w in own], np.int64)
                found.append(rows[at[np.argsort(-near[at], kind="stable")[:most]]] if len(at) else np.zeros((1, rows.shape[1]), np.float32))
        return found


def batched(texts: list[str], chars: int = 4_000_000) -> Iterator[list[int]]:
    """Positions of consecutive texts of about so many characters."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        batch.append(i)
        size += len(t) + 1
        if size >= chars:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def machine(z: np.ndarray, sign: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge support vector machine with equal class weights, by Newton steps; the last weight is the constant."""
    z = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-8)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        slack = np.maximum(0, 1 - sign * (z @ w))
        active = slack > 0
        gradient = penalty * w - z.T @ (weight * sign * slack)
        step = np.linalg.solve(np.diag(penalty) + (z[active] * weight[active, None]).T @ z[active], gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that passes the machine's boundary at one half."""
    a = 1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin, -30, 30)))
        step = ((p - y) @ margin / len(y)) / ((p * (1 - p)) @ np.square(margin) / len(y) + 1e-6)
        a = max(a - np.clip(step, -1, 1), 0.1)
        if abs(step) < 1e-8:
            break
    return a


def disguised(word: str, inserted: str = "xqz") -> list[str]:
    """The word with one letter put between two of its letters, as writers do to pass a filter."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in inserted]


def word_machine(bags: list[np.ndarray], y: np.ndarray, landmarks: list[str], toxic: int, ridge: float = 1e-3, rounds: int = 4) -> np.ndarray:
    """Weights on the kernels of a word by the machine over witnesses, with the Nyström map folded in; scaled to a margin of about 1."""
    features = Features(landmarks)
    own = features.of(landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    bags = [b.astype(float) @ root for b in bags]
    start = np.concatenate([np.full(toxic, 1.0), np.zeros(len(landmarks) - toxic)])
    w = np.append(np.linalg.solve(root, start), 0.0)
    clean = np.vstack([b for b, t in zip(bags, y) if not t])
    long = [v for word in landmarks[:toxic] if len(word) > 5 for v in disguised(word)]
    extra = features.of(long).astype(float) @ root if long else np.zeros((0, len(landmarks)))
    for _ in range(rounds):
        worst = np.array([(b @ w[:-1]).max() for b in bags])
        bar = np.quantile(worst[y == 0], 0.98)
        witness = [row for b, t, m in zip(bags, y, worst) if t and m > bar for row in b[b @ w[:-1] > bar]]
        if not witness:
            break
        z = np.vstack([np.array(witness), extra, clean])
        w = machine(z, np.where(np.arange(len(z)) < len(witness) + len(extra), 1.0, -1.0), ridge)
    return root @ w[:-1]


def stem_features(hits: np.ndarray, sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """How often stems occur, against what clean texts of that many words hold."""
    return np.log1p(hits) / np.log1p(1 + sizes[:, None] * rates[None])


def fit(bags: list[np.ndarray], hits: np.ndarray, sizes: np.ndarray, y: np.ndarray, landmarks: list[str], toxic: int, stems: list[str], ridge: float = 1e-3) -> dict:
    """Both machines and the logistic curve, which is folded into the weights of the second."""
    weights = word_machine(bags, y, landmarks, toxic) if landmarks else np.zeros(0)
    worst = np.array([max(0.0, (b.astype(float) @ weights).max()) for b in bags]) if landmarks else np.zeros(len(y))
    rates = (hits[y == 0] / np.maximum(sizes[y == 0], 1)[:, None]).mean(0)
    z = np.hstack([worst[:, None], stem_features(hits, sizes, rates)])
    w = machine(z, np.where(y > 0, 1.0, -1.0), ridge)
    margin = z @ w[:-1] + w[-1]
    # At most one clean training document in a thousand may pass, but half of what toxic ones reach must.
    found = margin[(y == 1) & (margin > 0)]
    shift = np.clip(1.1 * np.quantile(margin[y == 0], 0.999), 0, float(np.median(found)) / 2 if len(found) else 0.0)
    a = logistic(margin - shift, y)
    return {"landmarks": landmarks, "weights": weights, "stems": stems, "rates": rates, "second": w[:-1] * a, "bias": float(a * (w[-1] - shift))}


def score_of(model: dict, reader: Reader | None, texts: list[str]) -> np.ndarray:
    margin = np.full(len(texts), model["bias"])
    if reader:
        worst, hits, sizes = reader.read(texts)
        margin += np.hstack([np.maximum(worst, 0)[:, None], stem_features(hits, sizes, model["rates"])]) @ model["second"]
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def reader_of(model: dict) -> Reader | None:
    return Reader(model["landmarks"], model["stems"], model["weights"]) if model["landmarks"] or model["stems"] else None


def held_out(folds: int = 5):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def least_hash(words: str, seed: int) -> Column:
    return F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))


def heads_of(words: str, n: int) -> Column:
    """The first ``n`` letters of every longer word."""
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))


def distinct_pieces(ranked: list, most: int) -> list:
    """Rows of pieces, strongest first, without those that say little more than a chosen one: its longer forms, and parts met in the same documents."""
    chosen: list = []
    for r in ranked:
        bare = r["piece"].rstrip("$")
        kin = [c for c in chosen if c["piece"].rstrip("$").startswith(bare) or bare.startswith(c["piece"].rstrip("$"))]
        if not any(len(c["piece"].rstrip("$")) <= len(bare) or c["t"] >= 0.8 * r["t"] for c in kin):
            chosen.append(r)
    return chosen[:most]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, toxic_landmarks: int = 64, background: int = 4) -> dict:
    """A model from labelled rows outside the held-out fold.  Without both classes it gives the training rows' share of toxic ones."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = marks.count()
    slot = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    sample = F.broadcast(marks.where(slot < min(1_000_000, int(1_000_000 * most_rows / max(count, 1)))))  # about most_rows rows
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")))
    rows = docs.select("doc_id", text_of("text").alias("text")).join(sample, "doc_id").withColumn("words", words)
    # Near copies agree on three minima of word hashes nearly always; of rows that do, the smallest doc_id stands for all.
    minima = [least_hash("words", seed) for seed in range(3)]
    one = rows.groupBy(*minima, "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = cut(rows.join(one, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    flat = {"landmarks": [], "stems": [], "weights": np.zeros(0), "bias": float(np.log((bad + 0.5) / (good + 0.5))) if bad + good else -3.0}
    if not bad or not good:
        return flat
    base = bad / (bad + good)
    # A piece is a whole word, marked by $, or the head of a longer one.
    whole = F.transform(F.filter("words", lambda w: F.length(w).between(LENGTH, WIDE)), lambda w: F.concat(w, F.lit("$")))
    heads = [heads_of("words", n) for n in HEADS]
    counted = rows.select("toxic", F.explode(F.array_distinct(F.concat(whole, *heads))).alias("piece")).groupBy("piece")
    counted = counted.agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    counted = cut(counted.where(F.col("t") + F.col("c") >= 3))
    n, r = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    clean = F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - base))).otherwise(0.0)
    tied = counted.where((F.col("t") >= 3) & (r > base)).select("piece", "t", (n * (r * F.log(r / base) + clean)).alias("tied"))
    tied = tied.where(F.col("tied") >= float(np.log(max(counted.count(), 1) / CHANCE)))
    # Far more rows than are chosen, since kin of a chosen piece is passed over.
    ranked = tied.orderBy(F.desc(F.round("tied", 6)), F.desc(F.length("piece")), F.desc(F.endswith(F.col("piece"), F.lit("$"))), "piece").limit(32 * toxic_landmarks)
    chosen = [c["piece"] for c in distinct_pieces(ranked.collect(), toxic_landmarks)]
    if not chosen:
        return flat
    landmarks, stems = [c[:-1] for c in chosen if c.endswith("$")], [c for c in chosen if not c.endswith("$")]
    toxic = len(landmarks)
    if toxic:
        frequent = counted.where(F.endswith(F.col("piece"), F.lit("$")) & (F.length("piece") > LENGTH + 1)).orderBy(F.desc("c"), "piece").limit(background + toxic).collect()
        landmarks += [c for c in (r["piece"][:-1] for r in frequent) if c not in landmarks][:background]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(landmarks, stems)
        for b in batches:
            texts = b.column("text").to_pylist()
            x = [rows.ravel() for rows in reader.hard(texts, toxic)]
            _, hits, sizes = reader.read(texts)
            columns = [pa.array(x, pa.list_(pa.float32())), pa.array(list(hits), pa.list_(pa.float64())), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic").cast(pa.int32()), *columns], ["doc_id", "toxic", "x", "hits", "size"])

    schema = "doc_id long, toxic int, x array<float>, hits array<double>, size double"
    got = rows.select("doc_id", "toxic", "text").mapInArrow(pick, schema).toPandas().sort_values("doc_id")
    bags = [np.asarray(x).reshape(-1, len(landmarks)) for x in got["x"]] if landmarks else [np.zeros((1, 0))] * len(got)
    hits = np.vstack(got["hits"].to_numpy()) if stems else np.zeros((len(got), 0))
    return fit(bags, hits, got["size"].to_numpy(), got["toxic"].to_numpy().astype(float), landmarks, toxic, stems)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have no word and get the score of no likeness; a null doc_id counts as the empty id; repeated rows are scored
    alike; a text without white space is read in overlapping pieces.  Columns besides doc_id and text are not read.
    """
    model = train(docs, labels, **options)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            s = score_of(model, reader, texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of("text").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows not predicted toxic, with all their columns."""
    model = train(docs, labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            s = score_of(model, reader, texts)
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(keep, docs.schema)
