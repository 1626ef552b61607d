from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np

from corvane.llm.pii import BASE, LABELERS, Classifier, Reliability, digest, find_pii, masked, scan
from pyspark.sql import functions as F

from .helpers import empty, odd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def told(spans) -> str:
    return ",".join("%s:%d:%d" % s for s in spans)


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in digest(find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(told(want).encode()).hexdigest(), (text, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(told(want).split(",")) - {""} <= set(got[i].spans.split(","))
    return got


def test_hand_written(spark):
    check(
        spark,
        [
            "a@b.c.d_e@f.gh x@y.z..q@r.s a@b.co@d.ef @@@@ a@ @b.c", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 12.34.56.78x 1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 5 55 4111  1111",
            "+1 (499) 555-6503 +44 20 7946 0958. +1-- 2 +123 +4111111111111111", "é@x.com éa@x.com 😀 b@c.de 😀", "4111111111111111.1.1.1", "", "a" * 100_000, "1" * 100_000, "1." * 50_000, "a@" + "b." * 20_000 + "c", "+1" + "(" * 50_000,
        ],
    )


def test_random_strings(spark):
    rng = random.Random(5)
    check(spark, ["".join(rng.choice("ab1234567890.@+-() \n") for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_cards_among_digits(spark):
    rng = random.Random(6)
    cards = ["4111111111111111", "5500005555555559", "6011000990139424"]
    check(spark, [" ".join(rng.choice([*cards, "12", "-", "x", "1234 5678", "4111-1111 1111-1111", "+49 30 901820"]) for _ in range(12)) for _ in range(300)])


def test_added_kinds_and_masks(spark):
    text = 'mail joe (at) mail (dot) com, token = "abcdefgh12345678abcd", call +1 (499) 555-6503 now'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = find_pii(docs, carry=("text",))
    row = found.first()
    assert {s.kind for s in row.spans} >= {"phone", "secret"}
    assert "local" not in {s.kind for s in row.spans}  # inside the phone
    out = found.select(masked(F.col("text"), F.col("spans")).alias("m")).first().m
    assert "[PHONE] now" in out and "abcdefgh12345678abcd" not in out


def test_nothing_of_a_long_secret_stays(spark):
    long = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(10_000))
    texts = [f"say password={long} end", f"use ghp_{long[:500]} now", f"write {'j' * 80}oe (at) {'m' * 90}ail (dot) com, please", f"key sk-{long[:300]} and AKIA{long[:40].upper()} x"]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), carry=("text",))
    got = {r.doc_id: r.m for r in found.select("doc_id", masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert [got[i] for i in range(4)] == ["say [SECRET] end", "use [SECRET] now", "write [ADDRESS], please", "key [SECRET] and [SECRET] x"]


def test_gazetteer_and_context_propose(spark):
    texts = ["hello, my name is Zorblat Quux and I was born on 12.03.1988 there", "dob: 1 April 1999", "we met Alice Example", "Zorblat Quux 12.03.1988"]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    assert kinds[0] == [("person", 18, 30), ("birth", 49, 59)] and kinds[1] == [("birth", 5, 17)] and kinds[3] == []


def plain_mask(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_masks_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("aé😀 \n") for _ in range(rng.choice((0, 5, 1024, 1025, 5000))))
        spans = []
        for _ in range(rng.choice((0, 1, 3, 150)) if text else 0):
            start = rng.randrange(len(text))
            spans.append((start, rng.randrange(start + 1, min(len(text), start + rng.choice((2, 9, 3000))) + 1), rng.choice(["ip", "card"])))
        rows.append((i, text, spans))
    made = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,kind:string>>")
    got = {r.id: r.m for r in made.select("id", masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert all(got[i] == plain_mask(t, s) for i, t, s in rows)


def test_scans(spark):
    rng = random.Random(9)
    rows = [(n, [rng.randrange(-50, 50) for _ in range(n)]) for n in (0, 1, 63, 64, 65, 4096, 4097, 5000)]
    made = spark.createDataFrame(rows, "n int, v array<int>")
    got = made.select("n", scan(F.col("v"), 0, lambda a, b: a + b).alias("s"), scan(F.col("v"), -100, lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r, (_, v) in zip(got, rows):
        assert r.s == [sum(v[:i]) for i in range(len(v))]
        assert r.m == [max([-100, *v[:i]]) for i in range(len(v))]


def test_time_is_in_proportion_to_the_text(spark):
    line = "joe@mail.com 10.1.2.3, 4111111111111111, +1 (499) 555-6503 password=abcdefgh12345678 my name is Ann Lee\n"
    took = []
    for times in (400, 4000, 8000):
        docs = spark.createDataFrame([(1, line * times)], "doc_id long, text string")
        began = time.perf_counter()
        found = find_pii(docs, carry=("text",))
        assert found.select(F.size("spans").alias("n"), F.length(masked(F.col("text"), F.col("spans"))).alias("m")).first().n == 6 * times
        took.append(time.perf_counter() - began)
    print(took)
    assert took[2] < 3.2 * took[1]


def test_reliabilities_overrule_a_noisy_labeler():
    """One labeler votes at random; the truth and the others' rates are found."""
    rng = np.random.default_rng(3)
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = tuple(int(v) for v in [y if rng.random() < 0.9 else not y, y if rng.random() < 0.85 else not y, y if rng.random() < 0.9 else not y, rng.random() < 0.5, -1])
        counts[votes] = counts.get(votes, 0) + 1
    model = Reliability.fit([("secret", v, n) for v, n in sorted(counts.items())])
    assert abs(model.prior["secret"] - 0.4) < 0.03
    no, yes = model.rate[LABELERS[3]]
    assert abs(no[2] - 0.5) < 0.03 and abs(yes[2] - 0.5) < 0.03
    assert abs(model.rate[LABELERS[0]][1][2] - 0.9) < 0.03
    assert model.odds("secret", (1, 1, 1, 0, -1)) > 2 and model.odds("secret", (0, 0, 0, 1, -1)) < -2


def test_classifier_learns_its_own_features():
    """Posteriors that depend on the word before a span are learned from it."""
    rows = [("local", (3, 4, 0, 1, 1, word), 50.0, 50.0 * (0.95 if word < 8 else 0.05)) for word in range(17)]
    model = Classifier.fit(rows)
    pull = [model.weights["word"][w] for w in range(17)]
    assert min(pull[:8]) > max(pull[8:]) + 2


def test_odd_rows(spark):
    got = digest(find_pii(odd(spark))).collect()
    assert len(got) == odd(spark).count()
    assert sum(r.n_email for r in got) == 2 and sum(r.n_phone for r in got) == 2
    assert {r.spans for r in got if r.doc_id is None} == {""}


def test_empty(spark):
    assert digest(find_pii(empty(spark))).collect() == []
