from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tandemtape.llm import multiindex, ngramtrie, toxicity, webtext

from .helpers import clashing, frame, odd_rows, prose, remainder, words


LETTERS = str.maketrans("0123456789", "abcdefghij")


def test_kernel_agrees_with_its_definition():
    def slow(s, t):
        places = lambda x: combinations(range(len(x)), toxicity.LENGTH)
        return sum(toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in places(s) for b in places(t) if all(s[i] == t[j] for i, j in zip(a, b)))

    some = ["idiot", "idxiot", "banana", "xx", "nabanan"]
    for other in ("idiot", "ananas"):
        got = toxicity.kernel(toxicity.codes(some), toxicity.codes([other])[0])
        assert np.allclose(got, [slow(s, other) for s in some], rtol=1e-5)
    near = toxicity.Features(["worthless"]).of(["worthless", "worxthless", "wworthlesss", "harbour"])[:, 0]
    assert near[0] == pytest.approx(1, abs=1e-5) and near[1] > 0.5 and near[2] > 0.5 and near[3] == 0


def test_words_of_disguised_texts():
    assert toxicity.plain("id*i.ot!!") == "idiot" and toxicity.plain("m0r0n") == "moron" and toxicity.plain("***") == ""
    assert "idiot" in toxicity.words_of("you i d i o t now")
    assert len(toxicity.pieces("x" * 100)) > 1


def test_toxicity_learns_from_training_rows_only(spark):
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = prose(i, 60).translate(LETTERS) + (" you wretchedly scoundrel" if bad else "") + " " + prose(i + 9, 20).translate(LETTERS)
        rows.append((i, text, "en", "a", 0))
        marks.append((i, 1, int(bad) if i % 40 else 1))  # some labels are wrong
    marks += [(None, 1, 1), (5, None, None)]
    labels = frame(spark, marks, "doc_id long, quality int, toxic int")
    tests = [(1000, "an old scoun-drel", "en", "a", 0), (1001, "harmless words", "en", "a", 0), (1002, "a wretxchedly thing", "en", "a", 0)]
    odd = [(2000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd_rows()]
    docs = clashing(frame(spark, rows + tests + odd))
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + 13 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    by = {r.doc_id: r for r in got}
    held = [by[i] for i in range(600) if by[i].held_out]
    assert len(held) > 60 and all(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert (by[1000].predicted, by[1001].predicted, by[1002].predicted) == (1, 0, 1) and by[2002].predicted == 0
    wrong = frame(spark, [(d, q, 1 - t if d is not None and t is not None and remainder(d, 5) == 0 else t) for d, q, t in marks], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(docs, wrong).collect()} == {d: r.score for d, r in by.items()}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 0").count() == len(got) and toxicity.score(docs.limit(0), labels).count() == 0


def test_rare_short_and_inflected_insults_are_learned(spark):
    """An insult in 12 of 3,000 documents, one of three letters in 60, and a stem with free endings that clean documents hold now and then."""
    rows, marks, kind = [], [], {}
    for i in range(3000):
        text = prose(i, 60).translate(LETTERS).split()
        kind[i] = "rare" if i % 250 == 7 else "short" if i % 50 == 3 else "stem" if i % 20 == 11 else ""
        ending = lambda k: f"{i * 7 + k}".translate(LETTERS)
        if kind[i] == "stem":
            text[5:9] = [f"grumbel{ending(k)}" for k in range(4)]
        elif kind[i]:
            text[5] = {"rare": "zounderkite", "short": "oaf"}[kind[i]]
        elif i % 6 == 0:
            text[9] = f"grumbel{ending(1)}"
        rows.append((i, " ".join(text), "en", "a", 0))
        marks.append((i, 1, int(kind[i] != "")))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), frame(spark, marks, "doc_id long, quality int, toxic int")).collect()}
    for name in ("rare", "short", "stem"):
        held = [got[i].predicted for i in kind if kind[i] == name and got[i].held_out]
        assert held and np.mean(held) >= 0.9, (name, held)
    assert np.mean([got[i].predicted for i in kind if not kind[i]]) <= 0.01


@pytest.mark.parametrize("order", [2, 3])
def test_trie_scores_agree_with_counting(spark, order):
    rows = [(i, f"{prose(i, 30, 60)}\nThe END {prose(i % 7, 12)}", "en", "a", 0) for i in range(120)] + odd_rows()
    got = ngramtrie.score(clashing(frame(spark, rows)), order=order).collect()
    texts = [(r[0], words(r[1]) + ["</s>"]) for r in rows]
    counts = [Counter() for _ in range(order + 1)]
    follow = [Counter() for _ in range(order + 1)]
    padded = lambda t: ["<s>"] * (order - 1) + t
    for d, t in texts:
        if remainder(d, 7) != 2:
            for k in range(1, order + 1):
                for i in range(len(t)):
                    counts[k][tuple(padded(t)[i + order - k : i + order])] += 1
    for k in range(2, order + 1):
        for g in counts[k]:
            follow[k][g[:-1]] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    held = [sum(v for g, v in counts[k].items() if g[:-1] == c) for k in range(2, order + 1) for c in ()]
    assert not held
    sums = [Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, v in counts[k].items():
            sums[k][g[:-1]] += v
    once, twice = (sum(v == x for v in counts[1].values()) for x in (1, 2))
    discount = once / (once + 2 * twice)
    want = Counter()
    for d, t in texts:
        score = base = known = 0
        for i, w in enumerate(t):
            c = counts[1][(w,)]
            base += math.log10((c + 1) / (total + distinct + 1))
            known += c > 0
            p = (c - discount) / total if c else discount * distinct / total
            for k in range(2, order + 1):
                g = tuple(padded(t)[i + order - k : i + order])
                if sums[k][g[:-1]]:
                    p = max(counts[k][g] - ngramtrie.DISCOUNT, 0) / sums[k][g[:-1]] + ngramtrie.DISCOUNT * follow[k][g[:-1]] / sums[k][g[:-1]] * p
            score += math.log10(p)
        want[(d, len(t), known, round(base, 5))] += 1
        want[("score", d, len(t), known)] = score / len(t)
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.held_out == (remainder(r.doc_id, 7) == 2)
        assert want[(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5))] > 0
        assert abs(r.score / r.n_tokens - want[("score", r.doc_id, r.n_tokens, r.n_known)]) < 0.02 * order
    assert ngramtrie.score(frame(spark, [])).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="top">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div id="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First   <b>para</b>\ngraph.<p>Short.</p><aside>See also</aside><div class="ad-box">Buy now</div>'
    '<p>Second with <a href="x">link</a>&nbsp;&eacute;</p><form><p>Your mail</p><input name=q></form></article><section id="comments"><p>I liked this long comment a lot, thank you all</p></section><footer>&copy; Site</footer>'
)


def test_main_text_of_pages(spark):
    bare = "<body><div><a href=a>One</a> <a href=b>Two</a></div>" + "".join(f"<p>{prose(i, 50)}</p>" for i in range(3)) + "<div><a href=c>Three</a></div>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", bare), (5, "u", PAGE[: PAGE.index("Second") + 8]), (None, "u", "<p"), (6, "u", "<article>" + "<p>x</p>" * 5000), (1, "u", PAGE)]
    got = webtext.extract(clashing(frame(spark, rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Head & line\n\nFirst para graph.\n\nShort.\n\nSecond with link é"
    assert by[2] == by[3] == by[None] == "" and by[4] == "\n\n".join(prose(i, 50) for i in range(3))
    assert by[5].endswith("Second w") and by[6] == "\n\n".join("x" * 5000)
    assert webtext.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("before,after", [
    ("<body class='has-sidebar'><article>", "</article>"), ("<div class='content-with-sidebar'><article>", "</article></div>"), ("<article class='post category-legal'>", "</article>"),
    ("<article id='story-comments-on-law'>", "</article>"), ("<article><p class='share'>Share this", "</article>"), ("<article><ul><li class='share'>Share this<li>Listed</ul>", "</article>"),
])
def test_names_around_the_article_and_open_paragraphs_hide_nothing(before, after):
    told = [prose(i, 30) for i in range(3)]
    comments = "<section class='comments'><article class='comment'><p>I liked this a lot and read it twice in one evening</p></article></section>"
    page = "<nav><a href=a>Home</a></nav>" + before + "".join(f"<p>{t}</p>" for t in told) + after + comments + "<aside>More to read</aside>"
    got = webtext.main_text(page, webtext.trained())
    assert got.removeprefix("Listed\n\n") == "\n\n".join(told)


def test_tree_fits_its_table():
    rows = np.array([[float(v) for v in row.split()] for row in webtext.LABELLED.replace("\n", ";").split(";") if row.strip()])
    assert (webtext.trained().predict(rows[:, 1:]) == rows[:, 0].astype(bool)).all()


@pytest.mark.parametrize("offset,size", [(1e8, 1.0), (0.0, 1e200), (0.0, 1e-200)])
def test_neighbours_of_far_off_huge_and_tiny_vectors(spark, offset, size):
    x = offset + np.random.default_rng(4).normal(size=(900, 8)) * size
    got = multiindex.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 9 * 10
    hits = 0
    for q in range(0, 900, 100):
        apart = np.abs(x - x[q])
        unit = apart.max()
        far = unit * np.sqrt(np.square(apart / unit).sum(1))
        far[q] = np.inf
        wanted = set(np.lexsort((np.arange(900), far))[:10].tolist())
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        hits += len(wanted & {v for _, v, _ in own})
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(far[v], rel=1e-12) for _, v, s in own)
    assert hits >= 0.9 * 90


def test_nearest_rows_agree_with_differences_beside_an_outlier():
    r = np.random.default_rng(5)
    x, ids = np.vstack([r.normal(size=(300, 6)) + 1e8, np.full((1, 6), 1e200)]), np.arange(301)
    q = np.vstack([x[:20] + 1e-3, x[-1:]])
    allowed = r.random((21, 301)) < 0.7
    at, score, real = multiindex.nearest_rows(q, x, allowed, ids, 10)
    for i in range(21):
        far = multiindex.distances(q[i][None], x)
        assert at[i].tolist() == np.lexsort((ids, far, ~allowed[i]))[:10].tolist() and (score[i] == far[at[i]]).all() and real[i].all()
