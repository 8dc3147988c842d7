from __future__ import annotations

import hashlib
from collections import defaultdict

from tandemtape.llm import linededup, templates

from .helpers import ASCII, clashing, frame, odd_rows, prose


def test_lines_stay_in_the_largest_holder(spark):
    common = ["Common line number %d, which is longer than forty characters" % k for k in range(3)]
    rows = []
    for i in range(60):
        lines = [prose(i, 4), "  " + (common[i % 3].upper() if i % 2 else common[i % 3]) + "\t", "short line", common[0] if i < 4 else ""]
        rows.append((i, "\n".join(lines), "en", "a", 0))
    rows += odd_rows()
    rows = [(1000 + i if r[0] is not None and i >= 60 and r[0] != 5 else r[0], *r[1:]) for i, r in enumerate(rows)]
    got = linededup.dedup_lines(clashing(frame(spark, rows))).collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    holders = defaultdict(set)
    least = -(2**63)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(least if r[0] is None else r[0])
    want = defaultdict(list)
    for r in rows:
        lines, me = (r[1] or "").split("\n"), least if r[0] is None else r[0]
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and me < max(holders[key(x)]))]
        want[r[0]].append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append((r.n_lines, r.n_dropped, r.kept_text))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(r.n_dropped for r in got) > 50
    assert hashlib.sha256(b"").hexdigest()
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_merged_by_levels(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for batch in range(5):
        runs.add(frame(spark, [(1, 1, 100 - batch), (2, batch, 100 - batch), (2, batch, 100 - batch)], "h1 long, h2 long, did long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent(5).collect()] == [(1, 1, 5, 100)]


ITEM = "A train leaves the old station at 9 with 120 passengers and travels 35 km to the town of Arlen before it turns back home"


def test_leaks_with_other_numbers_names_and_places(spark):
    other = ITEM.replace("9", "7").replace("120", "88").replace("35 km", "50km").replace("Arlen", "Bergen")
    broken = "They sold 5 old red cars and 5 small blue vans and 5 long grey boats and 5 wide green carts that day"
    rows = [
        (1, f"{prose(1, 40)} {ITEM} {prose(2, 40)}", "en", "a", 0), (2, f"{prose(3, 30)} {other} {prose(4, 30)}", "en", "a", 0), (3, prose(5, 200), "en", "a", 0),
        (4, f"{prose(6, 30)} {broken.replace('5', '8')} {prose(7, 30)}", "en", "a", 0), (5, f"{prose(8, 9)} They sold 1 old red cars and 2 small blue vans and 3 long grey boats and 4 wide green carts that day", "en", "a", 0),
        (None, ITEM.upper(), None, None, None), (6, " ".join(ITEM.split()[:7]) + " " + prose(9, 50), "en", "a", 0), (7, f"{prose(10, 5000)} {ITEM}", "en", "a", 0),
    ]
    bench = frame(spark, [(10, ITEM), (11, broken), (12, None), (13, "too short"), (None, prose(77, 30)), (10, ITEM)], "item_id long, text string")
    docs = clashing(frame(spark, rows + odd_rows()))
    found = {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, bench).collect()}
    # Document 5 fits the template of item 11, but one value of it would stand for four.
    assert found >= {(1, 10), (2, 10), (4, 11), (7, 10)} and not {d for d, _ in found} & {3, 5, 6}
    kept = templates.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    # Rows go by id and text: the clean texts under ids 1, 2, 4 and null stay.
    assert (None, 10) in found and kept.count() == len(rows) + 10 - 5
    assert templates.find_leaks(frame(spark, []), bench).count() == 0 and templates.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_leaks_agree_with_brute_force(spark):
    """Templates without placeholders: the rule is word runs of eight and coverage."""
    items = [(i, prose(1000 + i, 20 + i, 300)) for i in range(12)]
    rows = []
    for i in range(60):
        item = items[i % 12][1].split()
        cut = item[: 6 + i % 20] if i % 3 else item[i % 5 :]
        rows.append((i, f"{prose(i, 50, 100_000)} {' '.join(cut)} {prose(500 + i, 20, 100_000)}", "en", "a", 0))
    got = {(r.doc_id, r.item_id) for r in templates.find_leaks(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    want = set()
    for d, text, *_ in rows:
        doc = text.split()
        have = {tuple(doc[j : j + 6]) for j in range(len(doc) - 5)}
        for i, item in items:
            item = item.split()
            hit = [tuple(item[j : j + 6]) in have for j in range(len(item) - 5)]
            covered = [any(hit[max(0, p - 5) : p + 1]) for p in range(len(item))]
            best = run = 0
            for c in covered:
                run = run + 1 if c else 0
                best = max(best, run)
            if best >= 8 and (2 * sum(covered) >= len(item) or best >= 13):
                want.add((d, i))
    assert got == want and want


def test_dense_and_short_items_are_met_word_for_word(spark):
    numbers, names, short = "Sort these numbers: 5 3 8 1 9 2 7 4 6 10", "Match Paris, Berlin, Rome, Madrid, Vienna with France, Germany, Italy, Spain and Austria", "Who wrote the 12 tables?"
    changed = [numbers.replace("5 3 8", "6 4 9"), names.replace("Paris", "Lyon").replace("Rome", "Turin").replace("Vienna", "Graz").replace("Italy", "Peru"), short.replace("12", "10")]
    rows = [(i, f"{prose(i, 20)} {t} {prose(50 + i, 21 + i)}", "en", "a", 0) for i, t in enumerate([numbers, names, short, *changed])] + [(9, short, "en", "a", 0)]
    bench = frame(spark, [(10, numbers), (11, names), (12, short)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in templates.find_leaks(frame(spark, rows), bench).collect()}
    assert found == {(0, 10), (1, 11), (2, 12), (9, 12)}


def test_texts_are_spaced_once_and_windows_hashed_row_by_row(spark):
    rows = frame(spark, [(1, ITEM, "en", "a", 0)]).selectExpr("doc_id as did", "text")
    plan = templates._runs(rows, ["did"], "text", [3], True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1 and "transform(sequence(" not in plan
