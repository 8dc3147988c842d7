from __future__ import annotations

import zlib
from collections import defaultdict

from tandemtape.llm import mixing, sharding

from .helpers import clashing, frame, odd_rows, prose, words


def filled(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Targets by rounds of resharing."""
    target, stopped, budget = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in stopped]
        rest = budget - sum(most * sizes[s] for s in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weights[s] / sum(weights[f] for f in free) for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        stopped |= over


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", f"s{i % 7}" if i % 3 else "hot", 0) for i in range(600)] + odd_rows()
    docs = clashing(frame(spark, rows))
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert (r.first_position is None) == (r.first_words == 0) and (r.second_words == 0 or r.first_words == r.size)
        assert r.first_position is None or 0 <= r.first_position <= 1
    assert all(want[s] - 1 < taken[s] <= want[s] + 1e-6 for s in sizes)
    again = mixing.plan_mix(docs.repartition(13)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_the_integral_of_the_schedule(spark):
    docs = frame(spark, [(i, "w " * 10, "en", "a", 0) for i in range(1000)])
    got = mixing.plan_mix(docs, schedules=[((0.0, 2.0), (1.0, 0.0))]).where("second_words > 0 or first_words > 0").collect()
    starts = sorted(p for r in got for p in (r.first_position, r.second_position) if p is not None)
    # Weight 2 - 2t integrates to 2t - t^2, so the k-th of n uses is due at 1 - sqrt(1 - k / n).
    assert len(starts) == 1500
    assert all(abs(p - (1 - (1 - k / 1500) ** 0.5)) < 1e-9 for k, p in enumerate(starts))


def test_curriculum_repeats_trims_and_keeps_columns(spark):
    rows = [(i, prose(i, 20), "en", "ab"[i % 2], 99) for i in range(40)]
    docs = clashing(frame(spark, rows))
    mixed, planned = mixing.curriculum(docs).collect(), mixing.plan_mix(docs).collect()
    assert mixed[0].__fields__ == docs.columns
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in planned)
    assert len(mixed) == sum((r.first_words > 0) + (r.second_words > 0) for r in planned)


def test_mixing_and_sharding_of_empty_tables(spark):
    empty = frame(spark, [])
    assert mixing.plan_mix(empty).count() == 0 and mixing.curriculum(empty).count() == 0 and sharding.kd_shards(empty).count() == 0


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rows = [(i, prose(i if i % 4 else 7, 30 + i % 50), "en" if i % 5 else None, f"s{i % 9}" if i % 3 else "hot", 0) for i in range(1500)]
    got = sharding.kd_shards(clashing(frame(spark, rows + odd_rows()[4:])), shards=10).collect()
    assert len(got) == len(rows) + 6
    size, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
    assert sorted(size) == list(range(10)) and max(size.values()) < 1.1 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in of_text.values()) <= 30  # only groups above a fiftieth of a shard are parted
    by_id = {r[0]: r for r in rows}
    for r in got:
        if r.doc_id in by_id and r.doc_id > 6:
            raw = by_id[r.doc_id][1].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)


def test_shards_of_odd_rows(spark):
    got = sharding.kd_shards(frame(spark, odd_rows()), shards=3).collect()
    assert len(got) == 10 and {r.size for r in got if r.doc_id in (1, 2)} == {16}


def test_amounts_follow_the_schedules(spark, monkeypatch):
    """What a document gives depends on when its uses end, so schedules that never reach the end take every use whole."""
    from pyspark.sql import functions as F

    # A source without any words has no target to divide by.
    docs = frame(spark, [(i, "w " * 10, "en", "a", 0) for i in range(100)] + [(100, "", "en", "b", 0)])
    assert sum(r.taken for r in mixing.plan_mix(docs, keep=["doc_id"]).collect()) == 1500
    monkeypatch.setattr(mixing, "due", lambda demand, rank, schedules: F.lit(0.5))
    assert sum(r.taken for r in mixing.plan_mix(docs, keep=["doc_id"]).collect()) == 2000


def test_amounts_come_from_the_walk_in_order_of_position(spark, monkeypatch):
    """Uses are given their words in the order of their positions, so amounts need them and the query computes them."""
    from pyspark.sql import functions as F

    docs = frame(spark, [(i, "w " * 7, "en", "a", 0) for i in range(101)])
    planned = mixing.plan_mix(docs, keep=["doc_id"])
    given = 0
    for at, words_taken in sorted((r[f"{k}_position"], r[f"{k}_words"]) for r in planned.collect() for k in ("first", "second") if r[f"{k}_words"]):
        assert words_taken == min(1060 - given, 7) and 0 <= at < 1
        given += words_taken
    assert given == 1060
    # Positions that run backwards put the use under way at the end first, where all its words are left.
    backwards = lambda demand, rank, schedules: F.when(demand < 1.0, 0.9 * (1.0 - demand)).otherwise(F.lit(1.0))
    monkeypatch.setattr(mixing, "due", backwards)
    assert mixing.plan_mix(docs, keep=["doc_id"]).agg(F.sum("taken")).first()[0] == 1064
