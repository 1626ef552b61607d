"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, stash, tune

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = range(3, 9)
#: Labelled rows that the model is fitted on, about and by a hash of id and text; all, if there are fewer.
SAMPLE = 12_000
#: The evidence (chi-squared, one degree of freedom) that each feature needs; every one that has it is taken.
EVIDENCE = 100.0
GRADES = 4
#: Words of which one with a feature makes it as dense as counts.
FULL = 100
#: Features counted in a worker's memory before they are passed on.
HELD = 300_000


def tokens(text: str) -> dict[str, int]:
    """How often each lower-case word occurs."""
    out: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def parts(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, toxic and not; summed as far as memory allows."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pydict({"feature": list(held), "toxic": [v[1] for v in held.values()], "clean": [v[0] for v in held.values()]}, schema=schema)
        held.clear()
        return rows

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for feature in {p for w in tokens((text or b"").decode("utf-8", "replace")) for p in parts(w)}:
                held.setdefault(feature, [0, 0])[toxic] += 1
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def values(found: dict[int, int], words: int, features: int) -> dict[int, float]:
    """Two values of each feature that a text has: how often, up to ten times, and
    how densely, up to one word in FULL."""
    out = {i: 1 + math.log(min(10, c)) for i, c in found.items()}
    out |= {features + i: min(1.0, FULL * c / words) for i, c in found.items()}
    return out


@dataclass
class Severity:
    """Features with shared weights, and ordered thresholds between the grades."""

    number: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.starts = {f[:3] for f in self.number}
        self.short = {f for f in self.number if len(f) < 3}
        self.lengths = sorted({len(f) - 1 for f in self.number if f.endswith("*")})

    def found(self, text: str) -> tuple[dict[int, int], int]:
        """How many words have each feature, and how many there are."""
        out: dict[int, int] = {}
        words = tokens(text)
        for word, count in words.items():
            if word[:3] not in self.starts and word not in self.short:
                continue
            for feature in (word, *[word[:n] + "*" for n in self.lengths if n <= len(word)]):
                i = self.number.get(feature)
                if i is not None:
                    out[i] = out.get(i, 0) + count
        return out, sum(words.values())

    def shares(self, found: list[tuple[dict[int, int], int]]) -> np.ndarray:
        """P(grade) for each text: differences of the cumulative links."""
        pull = np.array([sum(self.weights[i] * x for i, x in values(f, n, len(self.number)).items()) for f, n in found])
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - pull[:, None], -60, 60)))
        return np.diff(np.hstack([np.zeros((len(found), 1)), below, np.ones((len(found), 1))]), axis=1)


def fit_links(
    cells: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, grades: np.ndarray, start: np.ndarray | None = None, steps: int = 600, decay: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of largest likelihood, of sparse rows given as
    (row, column, value). The first threshold is free and the gaps above it are
    exponentials, so they stay ordered. ``start`` gives the weights to begin with."""
    last = int(GRADES - 1)
    p = np.concatenate([np.zeros(width) if start is None else start, [3.0], np.zeros(last - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(grades)
    rows = np.arange(n)
    row, column, value = cells
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(p[width + 1 :], -6, 6))
        cuts = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        pull = np.bincount(row, p[column] * value, n)
        s = 1 / (1 + np.exp(-np.clip(cuts[None, :] - pull[:, None], -60, 60)))
        full = np.hstack([np.zeros((n, 1)), s, np.ones((n, 1))])
        likely = np.maximum(full[rows, grades + 1] - full[rows, grades], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        # a row far on the wrong side must not drown the others
        high, low = np.minimum(slope[rows, grades + 1] / likely, 25), np.minimum(slope[rows, grades] / likely, 25)
        by_cut = np.zeros(last + 2)
        np.add.at(by_cut, grades + 1, high)
        np.add.at(by_cut, grades, -low)
        by_cut = by_cut[1:-1] / n
        g = np.concatenate([-np.bincount(column, (high - low)[row] * value, width) / n - decay * p[:width], [by_cut.sum()], np.array([by_cut[k:].sum() for k in range(1, last)]) * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(p[width + 1 :], -6, 6))
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def distinct(telling: list) -> list:
    """Without features that say the same as another one: of a word and its
    beginnings, or of nested beginnings, that nearly the same documents have,
    the longest of the most telling ones stays."""
    out = []
    by_stem: dict[str, list[int]] = {}  # documents that have features of this stem
    longer: dict[str, list[int]] = {}  # .. or of one that begins with it
    for r in sorted(telling, key=lambda r: (-round(r["odd"], 1), -len(r["feature"]), r["feature"][-1] == "*")):
        stem, both = r["feature"].rstrip("*"), r["t"] + r["c"]
        kin = [n for k in range(len(stem) + 1) for n in by_stem.get(stem[:k], [])] + longer.get(stem, [])
        if not any(abs(both - n) <= 0.05 * max(both, n) for n in kin):
            out.append(r)
            by_stem.setdefault(stem, []).append(both)
            for k in range(len(stem)):
                longer.setdefault(stem[:k], []).append(both)
    return out


def graded(toxic: np.ndarray, words: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Grades of labelled rows: 0 for clean ones, and 1 to 3 for toxic ones.

    There are no labels of severity, so it is estimated out of fold: each half
    of the rows learns how much more often toxic rows have each feature, and the
    other half's toxic rows are measured by it, divided by the square root of
    their length, so that neither short nor long texts are of one grade alone. A
    third of them is of each grade. No row's grade depends on what the row itself
    taught.
    """
    row, column, count = cells
    severity = np.zeros(len(toxic))
    for half in (0, 1):
        taught = (np.arange(len(toxic)) % 2 == half)[row]
        has = [np.bincount(column[taught & (toxic[row] == y)], minlength=width) for y in (0, 1)]
        n = [max(1, int(((np.arange(len(toxic)) % 2 == half) & (toxic == y)).sum())) for y in (0, 1)]
        tells = np.maximum(0, np.log((has[1] + 0.5) / (n[1] + 1)) - np.log((has[0] + 0.5) / (n[0] + 1)))
        severity += np.bincount(row[~taught], tells[column[~taught]] * count[~taught], len(toxic))
    severity /= np.sqrt(np.maximum(1, words))
    grades = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(severity[toxic == 1], [1 / 3, 2 / 3])
        grades[toxic == 1] = 1 + (severity[toxic == 1][:, None] > cuts).sum(1)
    return grades


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """Fit on about ``sample`` labelled documents, or on all if there are fewer.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; other rows are ignored; if
    an id has several, the largest counts). Grade 0 is a text that is not toxic;
    see ``graded`` for the others. Features are all words and beginnings that
    differ significantly between toxic and clean documents; only they reach the
    driver, and the rows of the sample that have them.
    """
    tune(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = stash(hash_sample(stash(chosen.withColumn("order", F.xxhash64("of")), "labels"), "order", sample).drop("order"), "labelled")
    # the sample is bounded, so it may go to every executor; an id may have many texts, so what it meets is sampled too
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    texts = stash(hash_sample(met.select("toxic", "text", F.xxhash64("of", "text").alias("order")), "order", sample), "sample")
    counted = texts.select("toxic", "text").mapInArrow(_counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Severity({}, np.zeros(0), np.array([50.0, 51.0, 52.0]))
    n, seen = float(toxic + clean), F.col("t") + F.col("c")
    odd = (F.col("t") * float(clean) - F.col("c") * float(toxic)) ** 2 * n / (float(toxic) * float(clean) * seen * (n - seen + 1))
    telling = distinct(counted.withColumn("odd", odd).where(F.col("odd") >= EVIDENCE).collect())
    number = {r["feature"]: i for i, r in enumerate(telling)}
    width = len(number)
    empty = Severity(number, np.zeros(2 * width), np.array([1.0, 2.0, 3.0]))
    schema = pa.schema([("order", pa.int64()), ("toxic", pa.int64()), ("words", pa.int64()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [empty.found((t or b"").decode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"order": batch.column(0).to_pylist(), "toxic": batch.column(1).to_pylist(), "words": [n for _, n in found], "at": [list(f) for f, _ in found], "times": [list(f.values()) for f, _ in found]}, schema=schema)

    rows = texts.select("order", "toxic", "text").mapInArrow(seen_in, "order long, toxic long, words long, at array<int>, times array<int>").collect()  # at most the sample
    rows.sort(key=lambda r: (r["order"], r["toxic"], r["words"], r["at"], r["times"]))
    words, isn = np.array([r["words"] for r in rows]), np.array([r["toxic"] for r in rows])
    lengths = [len(r["at"]) for r in rows]
    row, column, count = np.repeat(np.arange(len(rows)), lengths), np.array([i for r in rows for i in r["at"]], dtype=np.int64), np.array([c for r in rows for c in r["times"]], dtype=np.float64)
    grades = graded(isn, words, (row, column, count), width)
    both = [(k, i, x) for k, r in enumerate(rows) for i, x in values(dict(zip(r["at"], r["times"])), r["words"], width).items()]
    cells = (np.array([b[0] for b in both], dtype=np.int64), np.array([b[1] for b in both], dtype=np.int64), np.array([b[2] for b in both]))
    # each feature's own log odds: texts with many telling words would else never teach
    # that one of them is enough
    odds = [math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) for r in telling]
    weights, thresholds = fit_links(cells, 2 * width, grades, np.concatenate([np.clip(odds, -3, 6), np.zeros(width)]))
    return Severity(number, weights, thresholds)


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """Expected severity of every text, in one pass.

    Returns ``doc_id``, ``severity`` (0 to 3, the expected grade), ``grade`` (the
    likeliest), ``p_toxic`` (of any grade above 0) and ``toxic`` (whether that is
    at least one half). A null text counts as empty; a null id stays null;
    repeated rows give repeated results; texts are taken whole however long;
    columns beside ``doc_id`` and ``text`` are ignored; an empty table gives an
    empty result.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = model.shares([model.found((t or b"").decode("utf-8", "replace")) for t in batch.column(1).to_pylist()])
            p = 1 - shares[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(shares @ np.arange(GRADES)), pa.array(shares.argmax(1), pa.int32()), pa.array(p), pa.array(p >= 0.5)], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows (see ``fit``) and score all of them (see ``score``)."""
    return score(docs, fit(docs, labels, sample))
