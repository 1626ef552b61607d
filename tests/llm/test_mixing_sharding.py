from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from corvane.llm.mixing import mix, mixed_texts
from corvane.llm.sharding import shard

from .helpers import empty, odd


def targets(sizes: dict, share=1.5, most=2.0):
    """By resharing until none is above its cap."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(most * sizes[n] for n in capped)
        level = left / sum(weight[n] for n in free) if free else 0
        over = {n for n in free if weight[n] * level > most * sizes[n]}
        if not over:
            return {n: most * sizes[n] if n in capped else weight[n] * level for n in names}
        capped |= over


def test_mix_against_brute_force(spark):
    rng = random.Random(1)
    names = ["b", "a", "Z", "é", None, "hot"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))), rng.choice(names) if rng.random() < 0.6 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    partial = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n <= 1 for n in partial.values())
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))


def test_order_is_by_hash(spark):
    rows = [(i, "a b c", "s") for i in range(100)] + [(200, "x " * 1000, "t")]
    got = {r.doc_id: r.taken for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).collect()}
    text = hashlib.md5(b"a b c").hexdigest()
    order = sorted(range(100), key=lambda i: int(hashlib.md5(f"{i}:7:{text}".encode()).hexdigest()[:15], 16))
    counts = [got[i] for i in order]
    assert counts == sorted(counts, reverse=True)


def test_ranges_give_the_same(spark, monkeypatch):
    from corvane.llm import mixing

    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(str, mix(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(str, mix(df).collect())) == one


def test_many_sources(spark):
    """As many sources as rows, in turn of the weights by code point."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 6), f"s{i}") for i in range(1500)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)).collect()
    want = targets({s: len(t.split()) for _, t, s in rows})
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.taken == int(want[r.source] + 1e-9) for r in got)


def test_rows_without_an_id_have_keys_of_their_own(spark):
    rows = [(None, f"a{i} b c", "s") for i in range(400)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()
    assert sum(r.taken for r in got) == 600 and sum(r.taken == 3 for r in got) == 200


def test_mixed_texts(spark):
    rows = [(i, f" one{i}  two{i}\nthree{i} ", "en", f"s{i % 3}", 20) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mix(df).collect()}
    out = mixed_texts(df, df.columns)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert rows[r.doc_id][1].startswith(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_mix_odd_rows(spark):
    got = mix(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert {r.source for r in got} == {"src0", "src1", "src2", None}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", "")) == 0 for r in got if r.doc_id in (3, 4, 99))
    mixed_texts(odd(spark), odd(spark).columns).collect()
    assert mix(empty(spark)).collect() == [] and mixed_texts(empty(spark), empty(spark).columns).collect() == []
    nothing = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix(nothing).collect()] == [(0, 0.0, 0)]


def buckets(rows, limit):
    """By splitting the only bucket there is, and those that are too large."""
    key = lambda i: format(int(hashlib.md5(f"{'null' if i is None else i}:5".encode()).hexdigest()[:15], 16), "060b")
    todo, done = [("", [(i, n, key(i)) for i, n in rows])], {}
    while todo:
        prefix, held = todo.pop()
        if sum(n for _, n, _ in held) <= limit or len(prefix) == 60:
            done.update({i: prefix for i, _, _ in held})
        else:
            todo += [(prefix + bit, [r for r in held if r[2][len(prefix)] == bit]) for bit in "01"]
    return done


def test_shards_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(60)) for i in range(2000)] + [(5000, "x" * 3000)]
    for limit in (1000, 10_000, 10**9):
        got = shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
        want = buckets([(i, len(t.encode())) for i, t in rows], limit)
        assert {r.doc_id: r.shard.split("/")[0] for r in got if r.depth < 60} == {i: p for i, p in want.items() if len(p) < 60}
        held = Counter()
        for r in got:
            held[r.shard] += r.bytes
        assert all(held[r.shard] == r.shard_bytes for r in got)
        assert all(n <= limit for s, n in held.items() if n != 3000)


def test_overflow_pages(spark):
    rows = [(7, "x" * 10)] * 50 + [(7, "y" * 90), (8, "z" * 30)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    held = Counter()
    for r in got:
        held[r.shard] += r.bytes
    assert len(got) == 52 and max(held.values()) <= 100 and all(held[r.shard] == r.shard_bytes for r in got)


def test_pages_of_rows_without_an_id(spark):
    """Null ids fill many shards; none is above the limit, and small rows share pages."""
    rng = random.Random(5)
    rows = [(None, "x" * rng.randrange(0, 40)) for _ in range(3000)] + [(None, "y" * 70)] * 5 + [(3, "z" * 45)] * 4
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 100).collect()
    held, docs = Counter(), Counter()
    for r in got:
        held[r.shard] += r.bytes
        docs[r.shard] += 1
    assert len(got) == len(rows) and max(held.values()) <= 100
    assert all(held[r.shard] == r.shard_bytes and docs[r.shard] == r.shard_docs for r in got)
    assert len(held) <= 2.2 * sum(len(t) for _, t in rows) / 100
    again = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shard_odd_rows(spark):
    for limit in (100, 16 << 20):
        assert len(shard(odd(spark), limit).collect()) == odd(spark).count()
    assert shard(empty(spark)).collect() == []
