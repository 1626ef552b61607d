from __future__ import annotations

import math
import random

import numpy as np

from corvane.llm import quality as q
from corvane.llm import toxicity as t

from .helpers import empty, odd

DATA = "/root/testdata/sf0.01"


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 8)) < 0.1).astype(np.float32)
    grades = np.minimum(3, x.sum(1)).astype(int)
    row, column = np.nonzero(x)
    weights, thresholds = t.fit_links((row, column, x[row, column].astype(float)), 8, grades)
    assert (np.diff(thresholds) > 0).all() and weights.std() < 0.5 * weights.mean()
    pull = x @ weights
    assert (np.searchsorted(thresholds, pull) == grades).mean() > 0.99


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r for r in t.toxicity(docs, train).collect()}
    assert len(got) == docs.count()
    right = sum(got[i].toxic == bool(y) for i, y in test.items()) / len(test)
    clean = [got[i] for i, y in test.items() if not y]
    assert right > 0.93 and sum(r.toxic for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in got.values())


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, 0), (5, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = t.toxicity(odd(spark), labels).collect()
    assert len(got) == odd(spark).count()
    assert t.toxicity(empty(spark), labels).collect() == []
    nobody = t.toxicity(odd(spark), labels.where("false")).collect()
    assert len(nobody) == len(got) and not any(r.toxic for r in nobody)


def test_label_model_weighs_labellers():
    rng = random.Random(1)
    patterns: dict = {}
    names = list(q.LABELLERS)
    for _ in range(20_000):
        bad = rng.random() < 0.2
        v = tuple((0 if rng.random() < 0.6 else 1) if bad else (0 if rng.random() < 0.002 else 1) for _ in names[:5]) + (-1,) * (len(names) - 5)
        patterns[v] = patterns.get(v, 0) + 1
    model = q.LabelModel.fit(list(patterns.items()))
    assert abs(model.good - 0.8) < 0.03
    assert all(abs(bad - 0.6) < 0.05 and good < 0.006 for bad, good in model.faults[:5])


def test_label_model_overrules_a_noisy_labeller():
    """A labeller that finds fault with three texts in ten, good or bad, is not believed."""
    rng = random.Random(2)
    patterns: dict = {}
    for _ in range(20_000):
        bad = rng.random() < 0.2
        v = tuple(0 if rng.random() < (0.7 if bad else 0.002) else 1 for _ in range(5)) + (0 if rng.random() < 0.3 else 1,)
        patterns[v] = patterns.get(v, 0) + 1
    model = q.LabelModel.fit(sorted(patterns.items()))
    assert model.faults[5][1] > 0.2 and abs(model.good - 0.8) < 0.03
    assert model.posterior((1, 1, 1, 1, 1, 0)) > 0.95
    assert model.posterior((0, 0, 1, 1, 1, 1)) < 0.05


def plain_em(patterns, rounds):
    """The same model, without counts: one row at a time."""
    rows = [v for v, n in patterns for _ in range(n)]
    weigh = [share * len(rows) + 2 for _, share in (q.GOOD, q.FAULT, q.ALARM)]
    good, rates = q.GOOD[0], [[q.FAULT[0], q.ALARM[0]] for _ in rows[0]]
    for _ in range(rounds):
        soft = []
        for v in rows:
            yes, no = good, 1 - good
            for (b, g), x in zip(rates, v):
                if x >= 0:
                    yes, no = yes * (g if x == 0 else 1 - g), no * (b if x == 0 else 1 - b)
            soft.append(yes / (yes + no))
        for i in range(len(rates)):
            on = [(p, v[i]) for p, v in zip(soft, rows) if v[i] >= 0]
            rates[i] = [
                (q.FAULT[0] * weigh[1] + sum(1 - p for p, x in on if x == 0)) / (weigh[1] + sum(1 - p for p, _ in on)),
                (q.ALARM[0] * weigh[2] + sum(p for p, x in on if x == 0)) / (weigh[2] + sum(p for p, _ in on)),
            ]
        good = (sum(soft) + q.GOOD[0] * weigh[0]) / (len(rows) + weigh[0])
    return good, rates


def test_label_model_equals_plain_em():
    rng = random.Random(3)
    patterns: dict = {}
    for _ in range(500):
        bad = rng.random() < 0.3
        v = tuple(rng.choice((-1, 0 if rng.random() < (0.6 if bad else 0.05) else 1)) for _ in range(4))
        patterns[v] = patterns.get(v, 0) + 1
    model = q.LabelModel.fit(sorted(patterns.items()), rounds=30)
    good, rates = plain_em(sorted(patterns.items()), 30)
    assert np.allclose(model.good, good) and np.allclose(model.faults, rates)


def test_links_reach_the_largest_likelihood():
    """Likelihood by a plain loop, at the fit and around it."""
    rng = np.random.default_rng(1)
    x = rng.random((400, 3)) * (rng.random((400, 3)) < 0.5)
    grades = np.digitize(x @ [2.0, 1.0, -1.0] + rng.logistic(0, 0.4, 400), [0.5, 1.0, 1.5])
    row, column = np.nonzero(x)
    weights, cuts = t.fit_links((row, column, x[row, column]), 3, grades, steps=3000, decay=0.0)

    def loss(w, c):
        out = 0.0
        for k, g in enumerate(grades):
            low = 0.0 if g == 0 else 1 / (1 + math.exp(-(c[g - 1] - x[k] @ w)))
            high = 1.0 if g == 3 else 1 / (1 + math.exp(-(c[g] - x[k] @ w)))
            out -= math.log(max(high - low, 1e-12))
        return out / len(grades)

    best = loss(weights, cuts)
    for i in range(3):
        for step in (-0.05, 0.05):
            w, c = weights.copy(), cuts.copy()
            w[i] += step
            c[i] += step
            assert loss(w, cuts) >= best - 1e-4 and loss(weights, c) >= best - 1e-4


def test_grades_come_from_the_other_half():
    """A feature that only one row has says nothing of that row; dense texts grade higher than long ones."""
    rng = np.random.default_rng(2)
    toxic = (rng.random(600) < 0.3).astype(int)
    words = np.where(rng.random(600) < 0.5, 20, 400)
    row = np.flatnonzero(toxic)
    grades = t.graded(toxic, words, (row, np.zeros(len(row), dtype=np.int64), np.ones(len(row))), 1)
    assert (grades[toxic == 0] == 0).all() and (grades[toxic == 1] >= 1).all()
    assert grades[(toxic == 1) & (words == 20)].min() >= grades[(toxic == 1) & (words == 400)].max()
    alone = t.graded(np.array([1, 1, 0, 0]), np.full(4, 9), (np.array([0]), np.array([0]), np.array([5.0])), 1)
    assert alone[0] == alone[1]


def test_samples_of_repeated_ids_are_not_empty(spark):
    """Every id is the same, and there are more rows than the sample takes."""
    rng = random.Random(7)
    good, bad = " ".join(rng.choice(["the", "of", "and"]) + " " + "".join(rng.choice("aeioubcdlmnrst") for _ in range(7)) + rng.choice(["", "", ",", "."]) for _ in range(60)), "!!! ### " * 60
    for doc_id in (1, 2, 3, 5, 7):
        docs = spark.createDataFrame([(doc_id, good + f" end{i}" if i % 3 else bad + str(i)) for i in range(60)], "doc_id long, text string")
        kept = [r.kept for r in q.quality(docs, sample=20).collect()]
        assert sum(kept) == 40
        same = q.quality(docs.limit(1).crossJoin(spark.range(60)).select("doc_id", "text"), sample=20).collect()
        assert len(same) == 60
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    many = spark.range(3000).selectExpr("1 + id % 2 AS doc_id", "if(id % 2 = 0, concat('awful ', id), concat('nice ', id)) AS text")
    assert t.fit(many, labels, sample=50) is not None


def test_quality_on_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    good = [got[i] for i, y in truth.items() if y]
    bad = [got[i] for i, y in truth.items() if not y]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_quality_odd_rows(spark):
    got = q.quality(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert all(r.kept for r in got if r.doc_id in (3, 4, 12, 99))
    assert q.quality(empty(spark)).collect() == []


def test_keep_good_keeps_rows_whole(spark):
    docs = odd(spark)
    found = q.seen(docs, rows=True)
    model = q.fit(found)
    kept = q.keep_good(found, model)
    told = sorted((r.doc_id or -1, r.kept) for r in q.score(found, model).collect())
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [i for i, k in told if k]
    assert kept.columns == docs.columns and set(map(str, kept.collect())) <= set(map(str, docs.collect()))
