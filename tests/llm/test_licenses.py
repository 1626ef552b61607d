from __future__ import annotations

import math
import random
import re

import pytest

from corvane.llm.licenses import LOWER, PHRASES, TEMPLATES, TEXTS, UPPER, license_scan, prepared

from .helpers import empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text: str | None):
    words = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    more = set(labels)
    for t in prepared(TEMPLATES, 0.8):
        for i in range(0, len(words), t.step):
            block = set(words[i : i + t.length])
            if len(t.tokens & block) >= math.ceil(0.8 * len(t.tokens) - 1e-9) and t.must <= block and not t.without & block and (not t.own or t.own & block):
                more.add(t.label)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(labels), join(more)


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == brute(text), text


def test_hand_written(spark):
    check(spark, ["cc by cc by MIT License mit-license GNU\nGeneral  Public LICENSE apache_license", "the mit licenses", "K licenſe cc BY é cc by", "", None, "İMIT license", "word " * 30_000 + "mit license"])


def test_templates_in_random_texts(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()}) + [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(150))]
        for _, t in rng.sample(TEMPLATES, rng.randrange(3)):
            at, part = rng.randrange(len(words) + 1), [w for w in t.split() if rng.random() < 0.9]
            words[at:at] = part
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    check(spark, texts)


def labels(spark, texts, **settings):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(license_scan(rows, **settings).collect(), key=lambda r: r.doc_id)]


def test_labels_that_must_not_be_confused(spark):
    texts = {
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "licensed dogs under cats cc hens by owls 4 pigs 0 cows": "",
        "released the hounds under a license from the ministry": "",
        "licensed by ACME under section 4.0": "",
        "the the the the the the the": "",
    }
    assert dict(zip(texts, labels(spark, texts))) == texts


def test_bodies_are_found_within_other_text(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    for (label, text), got in zip(TEXTS, labels(spark, [f"{noise(77)} {text} {noise(91)}" for _, text in TEXTS])):
        assert label in got.split(","), (label, got)


def test_rows_that_share_an_id_keep_their_labels(spark):
    rows = spark.createDataFrame([(1, "released under the mit license"), (1, "nothing here at all"), (None, "licensed under CC BY-NC 4.0"), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.labels, r.score) for r in license_scan(rows).collect())
    assert got == [(0, "", 0.0), (0, "cc-by,cc-by-nc", 1.0), (1, "", 0.0), (1, "mit", 1.0)]


def test_phrases_that_overlap_themselves(spark):
    rows = spark.createDataFrame([(1, "x go go go y"), (2, "go go"), (3, "go")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_base, r.first_word, r.last_word) for r in license_scan(rows, phrases={"go go": "go"}).collect())
    assert got == [(1, 2, 1, 2), (2, 1, 0, 0), (3, 0, None, None)]


def test_too_many_templates_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan(empty(spark), templates=[("x", f"w{i}") for i in range(201)])


def test_odd_rows(spark):
    got = license_scan(odd(spark)).collect()
    assert len(got) == odd(spark).count() and all(r.n_base == 0 and r.score == 0 for r in got)


def test_empty(spark):
    assert license_scan(empty(spark)).collect() == []
