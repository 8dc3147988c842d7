from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tandemtape.llm import linking, multiindex, ngramjoin, substrings
from tandemtape.llm.common import BATCH_BYTES
from tandemtape.llm.components import components
from tandemtape.llm.eliasfano import EliasFano, encode

from .helpers import clashing, frame, odd_rows, prose, words


def edited(text: str, edits: int, seed: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def near_rows() -> list[tuple]:
    rows, n = [], 0
    for g in range(6):
        base = prose(g, 120)
        for k in range(12):
            rows.append((n, edited(base, k % 4, n), "en", "a", 0))
            n += 1
    rows += [(n + i, prose(3, 80), "en", "a", 0) for i in range(15)]  # copies
    rows += [(n + 20 + i, prose(1, 60) + " " + prose(900 + i, 60), "en", "a", 0) for i in range(10)]  # a shared passage
    return rows + [(n + 40, "two words", "en", "a", 0), (n + 41, "TWO words", "en", "a", 0)]


def brute_groups(rows, width: int, percent: int) -> list[set]:
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return sets, group


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_agree_with_brute_force(spark, width, percent):
    rows = near_rows() + [(500 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd_rows()]
    got = ngramjoin.similar_groups(clashing(frame(spark, rows)), width=width, percent=percent, part_rows=7).collect()
    sets, group = brute_groups(rows, width, percent)
    least = defaultdict(list)
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g].append(rows[i][0])
    want = sorted((r[0] if r[0] is not None else -1, len(s), min(least[g], default=-1)) for r, s, g in zip(rows, sets, group))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    kept = ngramjoin.one_of_each(clashing(frame(spark, rows)), width=width, percent=percent).collect()
    full = {g for g, s in zip(group, sets) if s}
    assert len(kept) == len(full) + sum(not s for s in sets)


def test_join_of_an_empty_table(spark):
    assert ngramjoin.similar_groups(frame(spark, [])).count() == 0 and ngramjoin.one_of_each(frame(spark, [])).count() == 0
    assert substrings.repeated_paragraphs(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 90)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2000 + r.randrange(80), 2000 + r.randrange(80)) for _ in range(60)] + [(7, 7)]
    r.shuffle(edges)
    group = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {row.node: row.component for row in components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {n: g for n, g in group.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_passages_set_into_texts_are_found(spark):
    def sentences(seed, n):
        r, out = random.Random(seed), []
        while n > 0:
            k = r.randrange(4, 14)
            s = [f"{''.join(r.choice('abcdefgh') for _ in range(5))}" for _ in range(k)]
            out.append(" ".join([s[0].capitalize(), *s[1:]]) + ".")
            n -= k
        return " ".join(out)

    passage = sentences(1, 60)
    rows, holders = [], set()
    for i in range(40):
        w = sentences(100 + i, 150).split()
        if i % 4 == 0:
            at = 20 + i
            w[at : at] = passage.split()
            holders.add(i)
        rows.append((i, " ".join(w), "en", "a", 0))
    near = sentences(7, 90)
    rows += [(100, sentences(8, 30) + "\n" + near, "en", "a", 0), (101, near.replace(near.split()[40], "changed", 1) + "\n" + sentences(9, 30), "en", "a", 0)]
    docs = clashing(frame(spark, rows + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd_rows()]))
    got = substrings.repeated_paragraphs(docs).collect()
    ids = {r.doc_id for r in got}
    assert holders | {100, 101} <= ids and not ids & (set(range(40)) - holders)
    assert all(r.removed == (r.doc_id != r.keeper_doc_id) and r.documents > 1 for r in got)
    cleaned = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    inner = " ".join(passage.split()[:20])
    assert inner in cleaned[0] and sum(inner in (t or "") for t in cleaned.values()) <= 2
    assert cleaned[1] == rows[1][1]
    sets = {}
    text = {r[0]: r[1] for r in rows}
    for r in got:  # every cluster of two is a true link
        w = words(text[r.doc_id])[r.first_word : r.first_word + r.n_words]
        sets.setdefault(r.cluster_id, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    for group in sets.values():
        assert all(max(len(a & b) / len(a | b) for j, b in enumerate(group) if j != i) >= 0.8 for i, a in enumerate(group))


def test_any_fifty_shared_words_meet(spark):
    def plain(seed, n):
        r = random.Random(seed)
        return [f"v{r.randrange(5000)}" for _ in range(n)]

    passage, rows, missed = plain(1, 50), [], 0
    for i in range(30):
        rows.append((i, " ".join([*plain(100 + i, 20 + i), *passage, *plain(200 + i, 70 - i)]), "en", "a", 0))  # no seam, no line, no sentence
    for seed in range(300):
        run = plain(seed, 50)
        held = []
        for side in (1, 2):
            w = [*plain(1000 * side + seed, 5 + seed % 40), *run, *plain(3000 * side + seed, 60)]
            held.append({tuple(w[a:b]) for a, b in substrings.paragraphs(" ".join(w).encode(), substrings.Words())[1][:, :2].tolist()})
        missed += not any(len(x) == 32 for x in held[0] & held[1])
    assert missed == 0
    got = substrings.repeated_paragraphs(frame(spark, [*rows, (50, " ".join(plain(999, 200)), "en", "a", 0)])).collect()
    assert {r.doc_id for r in got} == set(range(30))
    assert all(r.removed == (r.doc_id > 0) for r in got if r.documents == 30) and any(r.documents == 30 for r in got)
    changed = plain(5, 60)  # windows that differ in their last words are held together by their bands
    near = [(0, " ".join(plain(6, 40) + changed[:31] + plain(7, 40)), "en", "a", 0), (1, " ".join(plain(8, 40) + changed[:31] + plain(9, 40)), "en", "a", 0)]
    keys = [{tuple(w[a:b]) for a, b in substrings.paragraphs(t.encode(), substrings.Words())[1][:, :2].tolist()} for t in (near[0][1], near[1][1]) for w in (t.split(),)]
    grams = lambda w: {w[i : i + 5] for i in range(len(w) - 4)}
    close = any(len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)) for x in keys[0] for y in keys[1])
    assert close == bool(substrings.repeated_paragraphs(frame(spark, near)).count())


def test_bands_reach_the_recall():
    bands, rows = substrings.tuned(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_nearest_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 12))
    x = (centres[r.integers(0, 20, 3000)] + 0.3 * r.normal(size=(3000, 12))).astype(np.float32)
    x[100:140] = x[500]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(700, [float(v) for v in x[700]])]
    rows += [(10_000, None), (10_100, [0.0] * 12), (10_200, [float("nan")] * 12), (10_300, [1.0] * 5), (10_400, []), (None, [1.0] * 12), (10_500, [float("inf")] + [1.0] * 11), (10_600, [None] + [1.0] * 11)]
    vectors = clashing(frame(spark, rows, "vec_id long, embedding array<float>"))
    got = multiindex.search(vectors, sample_rows=1500, block_rows=64, slice_queries=7).collect()
    by = defaultdict(list)
    for row in got:
        by[row.query_id].append(row)
    assert sorted(by) == list(range(0, 3000, 100))
    hit = 0
    y = x.astype(float)
    for q, found in by.items():
        d = np.sqrt(np.square(y - y[q]).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        found.sort(key=lambda row: row.rank)
        assert [row.rank for row in found] == list(range(1, 11)) and all(abs(d[row.vec_id] - row.score) < 1e-12 for row in found)
        assert [(row.score, row.vec_id) for row in found] == sorted((row.score, row.vec_id) for row in found)
        hit += len({row.vec_id for row in found} & set(want.tolist()))
    assert hit / 300 >= 0.9
    few = multiindex.search(frame(spark, [(0, [1.0]), (100, [2.0]), (7, [4.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((q.query_id, q.rank, q.vec_id, q.score) for q in few) == [(0, 1, 100, 1.0), (0, 2, 7, 3.0), (100, 1, 0, 1.0), (100, 2, 7, 2.0)]
    assert multiindex.search(frame(spark, [(1, None)], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("n", "top"), [(1, 2**64 - 1), (5, 3), (1000, 2**64 - 1), (1000, 300), (70_000, 2**50)])
def test_elias_fano_round_trip_and_successor(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano(np.frombuffer(encode(v), np.uint8))
    assert (e.access(np.arange(n)) == v).all() and (e.whole() == v).all()
    asked = np.concatenate([v[:300], r.integers(0, top, 2000, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (e.successor(asked) == np.searchsorted(v, asked)).all()


def test_elias_fano_reads_words_without_spreading_their_bits(monkeypatch):
    r = np.random.default_rng(3)
    v = np.sort(r.integers(0, 2**40, 3000, dtype=np.uint64))
    e = EliasFano(np.frombuffer(encode(v), np.uint8))
    monkeypatch.setattr(np, "unpackbits", None)
    at, asked = r.permutation(3000), r.integers(0, 2**41, 3000, dtype=np.uint64)
    assert (e.access(at) == v[at]).all() and (e.successor(asked) == np.searchsorted(v, asked)).all()


def test_only_named_texts_are_cut_into_sets(spark):
    texts = [(1, 11, b"a b c d e"), (2, 12, b"f g h i j"), (3, 13, b"a b c d e")]
    rows = spark.createDataFrame(texts, "did long, th long, text binary")
    every = ngramjoin.survey(rows, 4, 8).where("class is null").select("key", "th").localCheckpoint()
    wanted = every.select("key").distinct()
    assert ngramjoin.whole_sets(rows, every, wanted, 4).count() == 2
    assert [len(r.set) for r in ngramjoin.whole_sets(rows, every.where("th = 12"), wanted, 4).collect()] == [16]


@pytest.mark.parametrize("size", [150, 600])
def test_pairs_tried_grow_with_a_group_not_with_its_square(spark, monkeypatch, size):
    base, tried, judge = prose(70, 150), [], linking.verified
    rows = [(i, edited(base, 1 + i % 2, 9000 + i), "en", "a", 0) for i in range(size)]  # one edit: linked; two: just apart from most
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: tried.append(pairs.count()) or judge(pairs, *rest))
    got = ngramjoin.similar_groups(frame(spark, rows), width=4, percent=85, part_rows=50).collect()
    assert sum(tried) <= 8 * size
    _, group = brute_groups(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(group))


def test_no_two_sets_are_further_apart_by_a_fine_sketch_than_they_are(spark):
    r = np.random.default_rng(8)
    sets = [np.sort(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 140, 150, 700, 5000)]
    sets += [np.sort(np.append(sets[2][:-k], r.integers(0, 2**63, k, dtype=np.uint64))) for k in (1, 5, 12)]
    table = frame(spark, [(i, s.tobytes()) for i, s in enumerate(sets)], "key long, set binary")
    made = linking.fine_sketches(table)
    far = linking._finely_apart()
    for x, y, apart in made.alias("x").join(made.alias("y")).select("x.key", "y.key", far).collect():
        true = len(np.setxor1d(sets[x], sets[y]))
        assert apart <= true and (true > 30 or apart == true)


def test_batches_of_the_join_are_bounded_by_bytes(spark, monkeypatch):
    seen, survey = [], ngramjoin.survey

    def watched(rows, *rest):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        seen.extend(r.n for r in rows.repartition(1).mapInArrow(sizes, "n long").collect())
        return survey(rows, *rest)

    monkeypatch.setattr(ngramjoin, "survey", watched)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual, long = spark.conf.get(name), prose(5, 30_000)
    ngramjoin.similar_groups(frame(spark, [(i, f"{i} {long}", "en", "a", 0) for i in range(60)])).count()
    assert len(seen) > 1 and max(seen) <= 1.2 * BATCH_BYTES and spark.conf.get(name) == usual


def test_texts_read_together_give_the_paragraphs_of_each():
    texts = [t.encode() for t in ["", "one", "\n\n", " ".join(["Ha ha."] * 40), *(edited(prose(i, 60 + i), 20, i).replace("w1", "W.\nA") for i in range(30))]]
    told, words_of, base = substrings.read(texts, substrings.Words()), substrings.Words(), 0
    got = {(a, b): k for (a, b), k in zip(told.spans().tolist(), told.keys().tolist())}
    sketches = dict(zip(got, substrings.sketches_of(told, told.spans()).tolist()))
    want = set()
    for text in texts:
        h, spans = substrings.paragraphs(text, words_of)
        want |= {(a + base, b + base) for a, b in spans.tolist()}
        base += len(h)
    assert set(got) == want and len(want) > 200
    for (a, b), sketch in sketches.items():
        own = np.unique(told.shingles[a : b - substrings.WIDTH + 1])
        assert sketch == [len(own), *linking.parity_sketch(own, 2).tolist()]
    by_words = {told.h[a:b].tobytes(): k for (a, b), k in got.items()}
    assert all(by_words[told.h[a:b].tobytes()] == k for (a, b), k in got.items()) and len(set(by_words.values())) == len(by_words)


def test_only_paragraphs_that_may_be_held_twice_are_banded(spark):
    """Bands of paragraphs that no other document can hold cost the most, so they are not made; no similar pair is lost by that."""
    passage = prose(7, 90)
    texts = [prose(100 + i, 300) for i in range(40)] + [f"{prose(200 + i, 60)}\n{edited(passage, i % 4, i)}\n{prose(300 + i, 60)}" for i in range(12)]
    told = substrings.read([t.encode() for t in texts], substrings.Words())
    at = told.marks()
    held = defaultdict(set)
    for mark, text in zip(told.shingles[at].tolist(), told.text(at).tolist()):
        held[mark].add(text)
    shared = {m for m, of in held.items() if len(of) > 1}
    marks = [k for k, m in zip(at.tolist(), told.shingles[at].tolist()) if m in shared]
    spans = told.spans()
    met = [any(a <= k <= b - substrings.WIDTH for k in marks) for a, b in spans.tolist()]
    sets = [set(told.shingles[a : b - substrings.WIDTH + 1].tolist()) for a, b in spans.tolist()]
    of, similar = told.text(spans[:, 0]), 0
    for i, j in combinations(range(len(spans)), 2):
        if of[i] != of[j] and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            similar += 1
            assert met[i] and met[j]
    assert similar > 100 and sum(met) < len(met) / 4
    rows = frame(spark, [(i, i, t.encode()) for i, t in enumerate(texts)], "did long, th long, text binary")
    table = spark.sparkContext.broadcast(linking.bitmap(substrings.shared_marks(rows), substrings.MARK_BITS))
    keys = {k for k, m in zip(told.keys().tolist(), met) if m}
    assert {r.key for r in substrings.banded(rows, 9, 4, table).collect()} == keys
