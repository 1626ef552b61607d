"""Quality by weak labels: overlapping heuristics, their accuracies, a hashed scorer."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hash_sample, stash, tune

#: Different rows that the scorer is trained on, about and by a hash of id and text; all, if there are fewer.
SAMPLE = 12_000
#: Places that features are hashed to.
PLACES = 1 << 14
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auf aus das dem den der die ein eine einen er es für ist mit nicht sich sie und von zu "
    "al con del el ella ha las lo los más no para por se sin su una y".split()
)
#: What is believed before any text is seen: the share of good texts, how often a
#: labeller finds fault with good and with bad ones, and how much each belief
#: weighs, in shares of all texts. Labellers are built to spare good texts; without
#: that belief a rare symptom would be explained as a habit of good ones.
GOOD, ALARM, FAULT = (0.8, 1.0), (0.005, 0.2), (0.3, 0.002)
PLAIN = frozenset(".,;:'\"()-?")
#: Codes of characters: X upper case, x other letters, 9 digits, a blank, ASCII
#: marks themselves, and ~ for every other mark. Beyond the table all letters are x.
TABLE = 0x3000


def _code(c: str) -> int:
    return ord("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c if c < "\x7f" else "~")


#: Shapes of ordinary words: letters, and one mark at the end.
ORDINARY = frozenset(w + m for w in (b"x", b"Xx", b"X") for m in (b"", b".", b",", b";", b":", b"?", b"!"))
CODES = np.array([_code(chr(i)) for i in range(TABLE)], dtype=np.uint8)
ODD = np.array([not chr(i).isalnum() and chr(i) != " " and chr(i) not in PLAIN for i in range(256)])


@dataclass
class Look:
    """What the heuristics and the scorer see of a text."""

    words: int
    symbols: float  # odd symbols for each word
    upper: float  # share of letters that are upper case
    pipes: float  # column marks for each word
    repeats: float  # share of words that equal the one before
    top: float  # share of the most frequent word
    lines: float  # share of lines that occurred before
    function: float  # share of function words
    stops: float  # share of words that end a phrase
    variety: float  # distinct words for each word
    squeeze: float  # compressed bytes for each byte
    letters: float  # share of characters that are letters
    plain: float  # share of words that are letters alone, or with a mark at the end
    n_lines: int
    shapes: Counter


def _squeeze(text: str) -> float:
    data = text.encode("utf-8", "replace")
    return len(zlib.compress(data, 1)) / max(1, len(data))


def look(text: str) -> Look:
    tokens = text.split()
    n = max(1, len(tokens))
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(points < TABLE, CODES[np.minimum(points, TABLE - 1)], ord("x")).astype(np.uint8)
    each = np.bincount(codes, minlength=256)
    upper, letters, odd = int(each[ord("X")]), int(each[ord("X")] + each[ord("x")]), int(each[ODD].sum())
    # runs of a code collapse; what is left between blanks are the tokens' shapes
    runs = codes[np.flatnonzero(np.diff(codes, prepend=0))].tobytes()
    shapes = Counter(s for s in runs.split(b" ") if s)
    ordinary = sum(k for s, k in shapes.items() if s in ORDINARY)
    return Look(
        len(tokens), odd / n, upper / max(1, letters), text.count("|") / n, sum(a == b for a, b in zip(tokens, tokens[1:])) / n,
        max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
        sum(k for t, k in counts.items() if t.lower() in FUNCTION_WORDS) / n, sum(k for t, k in counts.items() if t[-1] in ".,;:?!") / n,
        len(counts) / n, _squeeze(text), letters / max(1, len(points)), ordinary / max(1, sum(shapes.values())), len(lines), shapes,
    )


#: The heuristic labellers; each says 1 (good), 0 (bad) or -1 (does not apply).
#: Several look at each symptom in different ways, so their votes overlap.
LABELLERS = {
    "symbols": lambda x: 0 if x.symbols > 0.12 and x.symbols * x.words >= 5 else 1,
    "letters": lambda x: (0 if x.letters < 0.7 else 1) if x.words >= 40 else -1,
    "plain": lambda x: (0 if x.plain < 0.85 else 1) if x.words >= 40 else -1,
    "upper": lambda x: (0 if x.upper > 0.25 else 1) if x.words >= 5 else -1,
    "pipes": lambda x: 0 if x.pipes > 0.08 else 1,
    "repeats": lambda x: (0 if x.repeats > 0.12 else 1) if x.words >= 15 else -1,
    "top": lambda x: (0 if x.top > 0.3 else 1) if x.words >= 20 else -1,
    "lines": lambda x: (0 if x.lines > 0.4 else 1) if x.n_lines >= 4 else -1,
    "variety": lambda x: (0 if x.variety < 3 * math.sqrt(x.words) / x.words else 1) if x.words >= 30 else -1,
    "squeeze": lambda x: (0 if x.squeeze < 0.2 else 1) if x.words >= 30 else -1,
    "function": lambda x: (0 if x.function < 0.02 else 1) if x.words >= 20 else -1,
    "stops": lambda x: (0 if x.stops == 0 else 1) if x.words >= 40 else -1,
}


def votes(x: Look) -> list[int]:
    return [f(x) for f in LABELLERS.values()]


def hashed(x: Look) -> tuple[list[int], list[float]]:
    """Hashed features: shares of token shapes, and where the text's rates lie."""
    total = max(1, x.words)
    values: dict[int, float] = {}
    for s, k in x.shapes.items():
        place = zlib.crc32(b"s" + s) % PLACES
        values[place] = values.get(place, 0.0) + math.sqrt(k / total)
    for name in ("symbols", "upper", "pipes", "repeats", "top", "lines", "function", "stops", "squeeze"):
        step = int(min(9, getattr(x, name) * 20))
        place = zlib.crc32(f"r{name}{step}{x.words < 20}".encode()) % PLACES
        values[place] = values.get(place, 0.0) + 0.5
    return list(values), list(values.values())


@dataclass
class LabelModel:
    """A share of good texts, and how often each labeller finds fault.

    A labeller that does not apply to a text tells nothing about it.
    """

    good: float
    faults: list[tuple[float, float]]  # P(0 | applies) for bad and for good texts

    @classmethod
    def fit(cls, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> "LabelModel":
        """By expectation-maximisation over counts of vote patterns.

        Rates and shares are posterior means under the beliefs GOOD, ALARM and
        FAULT; nothing bounds them, so the votes of many texts overrule a belief:
        a labeller that finds fault with texts that the others find good is
        believed less.
        """
        total, k = sum(n for _, n in patterns), len(patterns[0][0]) if patterns else len(LABELLERS)
        held = [(mean, share * total + 2) for mean, share in (GOOD, FAULT, ALARM)]
        model = cls(GOOD[0], [(FAULT[0], ALARM[0])] * k)
        for _ in range(rounds):
            soft = [(v, n, model.posterior(v)) for v, n in patterns]
            faults = []
            for i in range(k):
                rates = []
                for good, (mean, weight) in enumerate(held[1:]):
                    mass = [mean * weight, (1 - mean) * weight]
                    for v, n, p in soft:
                        if v[i] >= 0:
                            mass[v[i]] += n * (p if good else 1 - p)
                    rates.append(mass[0] / sum(mass))
                faults.append((rates[0], rates[1]))
            mean, weight = held[0]
            model = cls((sum(n * p for _, n, p in soft) + mean * weight) / (total + weight), faults)
        return model

    def posterior(self, v: tuple[int, ...]) -> float:
        """P(good) of a vote pattern."""
        odds = math.log(self.good) - math.log(1 - self.good)
        for (bad, good), vote in zip(self.faults, v):
            if vote == 0:
                odds += math.log(good) - math.log(bad)
            elif vote == 1:
                odds += math.log1p(-good) - math.log1p(-bad)
        return 1 / (1 + math.exp(-max(-700, min(700, odds))))

    def accuracy(self) -> dict[str, float]:
        """Each labeller's estimated share of right votes where it applies."""
        return {name: self.good * (1 - good) + (1 - self.good) * bad for name, (bad, good) in zip(LABELLERS, self.faults)}


def fit_linear(rows: list[tuple[list[int], list[float], float]], steps: int = 250, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic loss against soft labels."""
    w, b = np.zeros(PLACES), 0.0
    if not rows:
        return w, b
    at = np.concatenate([np.array(r[0], dtype=np.int64) for r in rows])
    x = np.concatenate([np.array(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    m, v, mb, vb = np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(rows)) + b, -60, 60)))
        e = (p - y) / len(rows)
        g, gb = np.bincount(at, e[row] * x, PLACES) + decay * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w, b = w - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8), b - 0.1 * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def good(self, x: Look) -> float:
        """P(good) by the hashed linear scorer."""
        return self.of(*hashed(x))

    def of(self, at: list[int], values: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + float(self.weights[at] @ np.array(values))))))


SEEN = "doc_id long, order long, pattern binary, at array<int>, x array<double>"


def seen(docs: DataFrame, rows: bool = False) -> DataFrame:
    """What the labellers say of every text (a byte each: 0 nothing, 1 bad, 2 good) and
    its hashed features, written to the shared folder: texts are read once. With
    ``rows``, the whole row goes along as ``row``."""
    tune(docs.sparkSession)
    more = ["row"] if rows else []
    schema = pa.schema([("doc_id", pa.int64()), ("order", pa.int64()), ("pattern", pa.binary()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looks = [look((t or b"").decode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            pairs = [hashed(x) for x in looks]
            out = [batch.column(0), batch.column(1), pa.array([bytes(v + 1 for v in votes(x)) for x in looks], pa.binary()), pa.array([p[0] for p in pairs], schema.field(3).type), pa.array([p[1] for p in pairs], schema.field(4).type)]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[3:]], names=[*schema.names, *more])

    order = F.xxhash64(F.lit(10), F.col("doc_id").cast("long"), F.col("text"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("order"), F.col("text").cast("binary").alias("text"), *[F.struct(*docs.columns).alias(n) for n in more])
    whole = StructType.fromDDL(SEEN)
    for n in more:
        whole = whole.add(n, read.schema[n].dataType)
    return stash(read.mapInArrow(run, whole), "seen")


def fit(found: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The label model on the votes on every document, the scorer on about
    ``sample`` of them, or on all if there are fewer. ``found`` is what ``seen`` gives. What reaches the driver is
    at most 3^12 counts of patterns, and the sample's features."""
    counted = found.groupBy("pattern").count().collect()
    labels = LabelModel.fit(sorted((tuple(b - 1 for b in bytes(r["pattern"])), r["count"]) for r in counted))
    rows = sorted(hash_sample(found, "order", sample).select("pattern", "at", "x").collect(), key=lambda r: (bytes(r["pattern"]), r["at"], r["x"]))
    weights, bias = fit_linear([(r["at"], r["x"], labels.posterior(tuple(b - 1 for b in bytes(r["pattern"])))) for r in rows])
    return Scorer(labels, weights, bias)


def score(found: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``quality`` (P(good) by the scorer), ``weak_quality`` (by the
    label model alone), ``n_votes`` and ``kept`` (quality of at least ``least``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("weak_quality", pa.float64()), ("n_votes", pa.int32()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [tuple(b - 1 for b in p) for p in batch.column(1).to_pylist()]
            quality = [model.of(at, x) for at, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            out = {
                "doc_id": batch.column(0).to_pylist(), "quality": quality, "weak_quality": [model.labels.posterior(v) for v in said],
                "n_votes": [sum(x >= 0 for x in v) for v in said], "kept": [q >= least for q in quality],
            }
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return found.select("doc_id", "pattern", "at", "x").mapInArrow(run, "doc_id long, quality double, weak_quality double, n_votes int, kept boolean")


def keep_good(found: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """The rows that ``seen`` carried whose quality is at least ``least``, with all
    their columns. The weights are few and are part of the plan.

    Nulls, empty, long and repeated rows are judged as in ``quality``; an empty
    table gives an empty result.
    """
    weights = F.split(F.lit(",".join(map(repr, model.weights.tolist()))), ",").cast("array<double>")
    pulls = F.zip_with("at", "x", lambda i, x: F.get(weights, i) * x)
    good = 1 / (1 + F.exp(-F.aggregate(pulls, F.lit(float(model.bias)), lambda a, p: a + p)))
    return found.where(good >= least).select("row.*")


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Quality of every text, by a model of all of them; one row for each row.

    Returns what ``score`` does. A null text counts as empty, which no labeller
    minds; a null id stays null; repeated rows give repeated results and are one
    row of the sample; texts are taken whole however long; columns beside
    ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
    """
    found = seen(docs)
    return score(found, fit(found, sample))
