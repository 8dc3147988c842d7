"""Collocations, spelling variants and largest products against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tandemtape.llm import collocations, covertree, spelling
from tests.llm.helpers import ASCII, clashing, frame, odd_rows

# --- collocations ---------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000, covered=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if p in held and 100 * held[p] >= covered * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed: int, count: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["ab", "Ba", "c\x00d", "é", "x" * 50, "the", "new", "york", "times", "İ", " ", "日本"]
    rows = []
    for i in range(count):
        parts = [r.choice(words) if r.random() < 0.6 else r.choice(["the new york times", "ab ab ab", "new york"]) for _ in range(r.randrange(30))]
        text = "".join(p + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", "!"]) for p in parts)
        rows.append((i, text, r.choice(["en", "fr", None, "und", ""]), "a", 0))
    return rows


@pytest.mark.parametrize("least,top,covered", [(3, 2000, 100), (2, 5, 80), (10, 2000, 100)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, covered):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 200)
    rows = texts(5, 300) + [(None, None, None, None, None), (7, "", "en", "a", 0), (7, " .\t", "en", "a", 0)]
    got = collocations.collocations(clashing(frame(spark, rows)), least=least, top=top, covered=covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top, covered)


def test_hot_words_are_sliced_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_SHARE", 1 << 20)
    rows = [(i, "hot " + " hot ".join(f"w{random.Random(i).randrange(9)}" for _ in range(40)), "en", "a", 0) for i in range(60)]
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=5).collect()) == brute_phrases(rows, 5)


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_bits_for", lambda keys: 6)
    rows = texts(6, 200)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=2).collect()) == brute_phrases(rows, 2)


def test_odd_rows_and_no_rows(spark):
    rows = odd_rows()
    assert sorted(tuple(r) for r in collocations.collocations(clashing(frame(spark, rows)), least=20).collect()) == brute_phrases(rows, 20)
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None, None)])).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    """1000 * a * n and l * r are whole numbers of up to 30 digits before they are divided."""
    from pyspark.sql import functions as F

    a, n, l, r = 3_000_000_000_007, 90_000_000_000_000_001, 5_000_000_000_011, 7_000_000_000_013
    wide = lambda v, p: F.lit(str(v)).cast(f"decimal({p},0)")
    above = (wide(1000, 4) * wide(a, 15)) * wide(n, 19)
    assert spark.range(1).select(F.call_function("div", above, wide(l, 19) * wide(r, 19))).first()[0] == 1000 * a * n // (l * r)


# --- spelling variants --------------------------------------------------------------------------------------------------


def brute_spellings(rows, every=199, shortest=6, least=5, ratio=5):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= ratio * n[w] else None
        out[w] = [form, None, n[w], len(close), n[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return sorted((w, *rest) for w, rest in out.items())


def misspelt(seed: int, count: int) -> list[tuple]:
    r = random.Random(seed)
    stems = ["abcdef", "abcdefg", "Straße", "élèveÿs", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "internationale", "ÀÁÂÃÄÅ×÷"]

    def slip(word):
        at, kind = r.randrange(len(word)), r.random()
        return word[:at] + (r.choice("abé") if kind < 0.6 else "") + word[at + (kind > 0.3) :]

    rows = []
    for i in range(count):
        rows.append((i if i % 7 else None, r.choice([" ", "_", "'", "9"]).join(w if r.random() < 0.8 else slip(w) for w in (r.choice(stems) for _ in range(r.randrange(60)))), "en", "a", 0))
    return rows


@pytest.mark.parametrize("every,shortest,least,ratio", [(199, 6, 5, 5), (3, 6, 1, 2), (2, 7, 2, 3)])
def test_spellings_equal_brute_force(spark, every, shortest, least, ratio):
    rows = misspelt(3, 250) + odd_rows()
    got = spelling.variants(clashing(frame(spark, rows)), every=every, shortest=shortest, least=least, ratio=ratio)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_spellings(rows, every, shortest, least, ratio)


def test_every_edit_of_a_word_meets_it(spark):
    r = random.Random(9)
    words = set()
    for length in range(6, 14):
        word = "".join(r.choice("abcdé") for _ in range(length))
        words.add(word)
        for i in range(length):
            words |= {word[:i] + word[i + 1 :], word[:i] + "z" + word[i + 1 :], word[:i] + "z" + word[i:], word + "z"}
    words = sorted(w for w in words if len(w) >= 6)
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    got = {tuple(sorted((p.a, p.b))) for p in pairs}
    assert len(got) == len(pairs)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def test_long_ways_to_the_root_and_no_rows(spark):
    ladder = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(i, " ".join([w] * 3**i), "en", "a", 0) for i, w in enumerate(ladder)]
    got = {r.word: r.root for r in spelling.variants(frame(spark, rows), every=10**10, least=1, ratio=3).collect()}
    assert got == dict.fromkeys(ladder, "aabbbb")
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None, None, None, None)])).collect() == []


# --- largest products -----------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<double>, label int"


def brute_products(rows, every=100, k=10):
    kept = [(i, v, [int(x) * 1024 if abs(x) >= 2.0**52 else math.floor(x * 1024) for x in e]) for i, (v, e, *_) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, x in kept:
        if v is None or v % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(x, y)), w is None, w if w is not None else 0) for j, w, y in kept if j != i)[:k]
        out += [(v, r + 1, None if none else w, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, none, w) in enumerate(best)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def vectors(seed, count, kind):
    r = np.random.default_rng(seed)
    if kind == "clusters":
        x = r.normal(size=(8, 12))[r.integers(0, 8, count)] + r.normal(size=(count, 12)) * 0.01
    elif kind == "copies":
        x = r.normal(size=(count, 12))
        x[: count // 2] = x[0]
    else:
        x = r.normal(size=(count, 12))
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "plain"])
def test_products_equal_brute_force(spark, kind):
    rows = vectors(2, 700, kind)
    got = covertree.search(clashing_vectors(spark, rows), every=20, block_rows=100, group_rows=7)
    assert found(got) == brute_products(rows, 20)


def clashing_vectors(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, VEC)
    for name in ("x", "uid", "pivot", "group", "part", "rank", "score", "worst", "norm", "query_id", "by"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 150, "plain")
    rows += [(None, rows[3][1], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan], 1), (300, [inf], 1), (400, [], 1), (500, [0.0] * 12, 1), (600, [5.0], 1)]
    rows += [rows[0], rows[0], (0, [2.0] * 12, 1), (700, [1.0] * 40, 1), (-100, [-0.0001] * 12, 1)]
    assert found(covertree.search(clashing_vectors(spark, rows), block_rows=40)) == brute_products(rows)


def test_wide_vectors_are_ranked_exactly(spark):
    rows = vectors(4, 60, "plain")
    rows += [(100, [1e200] * 12, 1), (101, [1e200] * 11 + [1.0001e200], 1), (200, [1e8 + i for i in range(12)], 1), (102, [-1e200] * 12, 1), (103, [1e8] * 12, 1), (300, [1e308, 1e308], 1)]
    assert found(covertree.search(spark.createDataFrame(rows, VEC), block_rows=20)) == brute_products(rows)


def test_few_or_no_vectors(spark):
    empty = covertree.search(spark.createDataFrame([], VEC))
    assert empty.collect() == [] and empty.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert covertree.search(spark.createDataFrame([(100, [1.0], 0)], VEC)).collect() == []
    assert found(covertree.search(spark.createDataFrame([(100, [1.0], 0), (1, [2.0], 0)], VEC))) == [(100, 1, 1, 2 * 1024 * 1024)]
    assert covertree.search(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], VEC)).collect() == []


def test_tree_covers_and_separates():
    r = np.random.default_rng(1)
    x = np.floor(np.concatenate([r.normal(size=(6, 5))[r.integers(0, 6, 900)] * 1000 + r.normal(size=(900, 5)), np.zeros((100, 5))]))
    tree = covertree.grow(np.arange(1000), np.arange(1000), x)
    assert sorted(tree.uid) == list(range(1000)) and tree.children.max() > 0
    for node in range(len(tree.center)):
        rows = slice(tree.begin[node], tree.end[node])
        assert covertree.away(tree.x[rows], tree.x[tree.center[node]]).max() <= tree.radius[node] + 1e-9
        kids = np.arange(tree.child[node], tree.child[node] + tree.children[node])
        if len(kids):
            assert [*tree.begin[kids], tree.end[kids[-1]]] == [tree.begin[node], *tree.end[kids]]
            centers = tree.x[tree.center[kids]]
            apart = [covertree.away(centers[:i], centers[i]).min() for i in range(1, len(kids))]
            assert min(apart) > tree.radius[node] / covertree.SHRINK - 1e-9 and tree.radius[kids].max() <= tree.radius[node] / covertree.SHRINK + 1e-9


def test_pruning_skips_most_products_of_clustered_data():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(60, 8))[r.integers(0, 60, 4000)] * 1024 + r.normal(size=(4000, 8)))
    data = covertree.grow(np.arange(4000), np.arange(4000), x)
    queries = covertree.grow(np.arange(1000), np.arange(1000), x[:1000])
    best = covertree.Best(1000, 10, np.full(1000, -np.inf))
    assert covertree.dual_search(queries, data, best) < 0.2 * 1000 * 4000
    for q in range(0, 1000, 10):
        scores = x @ queries.x[q]
        scores[queries.uid[q]] = -np.inf
        expected = np.lexsort((np.arange(4000), -scores))[:10]
        assert list(best.found[q][1]) == list(expected)


def test_ordered_bytes_sort_as_numbers():
    r = random.Random(2)
    numbers = [r.choice([-1, 1]) * r.randrange(2 ** r.choice([1, 7, 8, 9, 63, 64, 700])) for _ in range(500)] + [0, -1, 127, 128, 255, 256, -128, -129, -256]
    assert sorted(numbers) == sorted(numbers, key=covertree.ordered)


def test_chunks_of_words_are_never_broadcast(spark, tmp_path):
    """Spark sizes the chunks by the file of the words before they are exploded, so a side that looks small may not fit the driver."""
    frame(spark, [(f"word{i:06d}",) for i in range(3000)], "word string").write.parquet(str(tmp_path / "words"))
    near = spelling.near_words(spark.read.parquet(str(tmp_path / "words")))
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().sparkPlan().toString()
    assert near.count() > 3000 and "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
