from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import buckets
from corvane.llm.ngram_join import bands_for, likely, ngram_join, shingles, sketch

from .helpers import WORDS, empty, odd


def brute(rows, threshold=0.8):
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    group = {i: i for i in ids}
    while True:
        new = {i: min([group[i], *(group[j] for j in links[i])]) for i in ids}
        if new == group:
            return {i: (len(links[i]), group[i]) for i in ids}
        group = new


def near_copies(seed: int, groups: int, copies: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(80)]
        for c in range(copies):
            changed = list(words)
            for _ in range(c % 4):
                changed[rng.randrange(80)] = "changed" + str(rng.randrange(9))
            out.append((len(out), " ".join(changed)))
    return out


def test_equals_brute_force(spark):
    rows = near_copies(1, 12, 9)
    got = {r.doc_id: (r.n_links, r.group_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert any(n for n, _ in got.values())


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SKETCH_ROWS", 8)
    monkeypatch.setattr(buckets, "EXACT_ROWS", 4)
    rows = near_copies(2, 3, 30)
    got = {r.doc_id: (r.n_links, r.group_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = ngram_join(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_links for r in by[1]] == [4] and by[1][0].class_id == 0  # 0 three times, and 2
    assert all(r.n_links == 0 and r.kept for i in (3, 4, 5, 99, None) for r in by[i])
    assert by[6][0].group_id == by[7][0].group_id == 6
    assert {r.class_id for i in (8, 9) for r in by[i]} == {8}


def test_empty(spark):
    assert ngram_join(empty(spark)).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.9999)):
        bands, rows = bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def boilerplate(texts: int) -> list[tuple[int, str]]:
    """Texts whose pairs have a similarity of about one half."""
    rng = random.Random(3)
    shared = " ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(200))
    return [(i, shared + " " + " ".join(f"own{i}w{k}" for k in range(98))) for i in range(texts)]


def test_boilerplate_goes_no_further_than_sketches(spark, monkeypatch):
    """Full sets are asked for only where sketches agree."""
    asked = []
    plain = buckets.join_by_buckets

    def spied(members, likely, exact, near):
        def counted(going):
            asked.append(going.select(F.sum(F.size("where"))).first()[0] or 0)
            return exact(going)

        return plain(members, likely, counted, near)

    from corvane.llm import ngram_join as module

    monkeypatch.setattr(module, "join_by_buckets", spied)
    monkeypatch.setattr(buckets, "SKETCH_ROWS", 64)
    rows = boilerplate(600) + [(1000, boilerplate(1)[0][1] + " end")]
    got = {r.doc_id: (r.n_links, r.group_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (1, 0) and got[1000] == (1, 0)
    assert sum(n for n, _ in got.values()) == 2
    assert asked[0] <= 30


def test_sketches_spare_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    lost = 0
    for size in (9, 45, 180, 900, 9000):
        pairs = []
        for _ in range(100):
            both, other = rng.integers(0, 2**63, size * 8 // 9, dtype=np.uint64), rng.integers(0, 2**63, (2, size // 9), dtype=np.uint64)
            pairs.append([sketch(np.unique(np.concatenate([both, x]))) for x in other])
        lost += int((~np.diag(likely(0.8)([a for a, _ in pairs], [b for _, b in pairs]))).sum())
    assert lost <= 1


def test_rows_that_share_an_id_and_not_a_text(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, three)]
    got = sorted((r.doc_id, r.n_links, r.group_id, r.kept) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
