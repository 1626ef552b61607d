"""Embedding near-duplicates by spherical-cap filters from random product codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import join_by_buckets
from .common import stash, tune

SEED = 64
#: Vectors that a cap may hold on average, codewords of one part, and trial pairs.
FILLS, WORDS, TRIALS = (128, 512, 2048), tuple(2**k for k in range(2, 13)), 500
#: From this many dimensions on, caps are sums of codewords from two halves.
HALVED = 16
#: A cap is never narrower than this cosine, or pairs would not fit into one.
NARROWEST = 0.85
#: What a choice of codes costs, in seconds: a copy of a sketch sent, a
#: multiplication, and a codeword compared.
COPY, PRODUCT, WORD = 1e-5, 3e-11, 1e-9
_built: dict[tuple, "ProductCode"] = {}


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def height_for(dim: int, share: float) -> float:
    """The cosine from which a cap holds about ``share`` of random directions."""
    low, high = 0.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid) > share else (low, mid)
    return min(low / math.sqrt(dim), NARROWEST)


class ProductCode:
    """Caps of a rotated space: around codewords, or around all sums of a codeword
    from each of its two halves."""

    def __init__(self, dim: int, least: float, words: int, number: int):
        self.made_of = dim, least, words, number
        rng = np.random.default_rng([SEED, dim, words, number])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        self.cut = dim if dim < HALVED else (dim + 1) // 2
        self.words, self.least = words, least
        self.first = self._words(rng, words, self.cut) * math.sqrt(self.cut / dim)
        self.second = self._words(rng, words, dim - self.cut) * math.sqrt(1 - self.cut / dim)
        # a hash of the length and the number keeps caps of different codes apart
        self.tag = int.from_bytes(hashlib.blake2b(f"{dim} {number}".encode(), digest_size=8).digest(), "little") >> 1 & ~((1 << 26) - 1)

    def __reduce__(self):
        # a task gets the numbers, and its process builds each code once
        return _code, self.made_of

    @staticmethod
    def _words(rng: np.random.Generator, count: int, dim: int) -> np.ndarray:
        x = rng.standard_normal((count, dim)) if dim else np.zeros((1, 0))
        return (x / np.linalg.norm(x, axis=1, keepdims=True) if dim else x).astype(np.float32)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, and ids of the caps that hold them: of each half, only
        codewords that the other's best one lifts to the height are combined."""
        x = unit.astype(np.float32) @ self.turn
        one, two = x[:, : self.cut] @ self.first.T, x[:, self.cut :] @ self.second.T
        row, a = np.nonzero(one >= self.least - two.max(1, keepdims=True))
        other, b = np.nonzero(two >= self.least - one.max(1, keepdims=True))
        if not len(row):
            return row, a
        # each first codeword meets the second ones of its row
        starts, counts = np.searchsorted(other, row), np.bincount(other, minlength=len(unit))[row]
        pick = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        row, a, b = np.repeat(row, counts), np.repeat(a, counts), b[pick]
        hit = one[row, a] + two[row, b] >= self.least
        return row[hit], self.tag + a[hit] * len(self.second) + b[hit]


def _code(*made_of) -> ProductCode:
    if made_of not in _built:
        _built[made_of] = ProductCode(*made_of)
    return _built[made_of]


def pairs_at(dim: int, cosine: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, and for each another one at this cosine."""
    x, z = np.random.default_rng([SEED, dim, seed]).standard_normal((2, count, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z if dim > 1 else x


def _tried(dim: int, least: float, words: int, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Shares of pairs that two codes miss, and caps of a vector in one."""
    missed, caps = 0.0, 0.0
    for number in (0, 1):
        (i, a), (j, b) = (ProductCode(dim, least, words, number).decode(x) for x in pairs)
        met = set(zip(i.tolist(), a.tolist())) & set(zip(j.tolist(), b.tolist()))
        missed += 1 - len({i for i, _ in met}) / TRIALS
        caps += len(i) / TRIALS
    return max(missed / 2, 0.5 / TRIALS), caps / 2


def codes_for(dim: int, vectors: int, threshold: float, recall: float) -> list[ProductCode]:
    """Independent codes in which two vectors whose cosine is ``threshold`` share
    a cap with a probability of about ``recall``.

    For each load of a cap and each number of codewords the miss rate of a code
    and the caps of a vector are simulated on random pairs at the threshold; what
    costs least is taken. The tries are few whatever the number of vectors, and
    wide caps, which miss nothing, are always among them.
    """
    pairs = pairs_at(dim, threshold, TRIALS, 0)
    best = None
    for fill in FILLS:
        least = height_for(dim, min(0.25, fill / max(1, vectors)))
        share = max(fill / max(1, vectors), float(np.mean(pairs[0][:, 0] >= least)) if least == NARROWEST else 0.0)
        for words in WORDS:
            missed, caps = _tried(dim, least, words, pairs)
            if missed > 0.97:
                continue
            number = math.ceil(math.log(1 - recall) / math.log(missed))
            cost = number * (caps * (COPY + share * vectors * dim * PRODUCT) + 2 * words * (WORD + dim * PRODUCT / 2) + dim**2 * PRODUCT)
            if best is None or cost < best[0]:
                best = (cost, least, words, number)
            if caps > 4:
                break
    if best is None:  # all caps are too narrow: one that holds everything
        return [ProductCode(dim, -2.0, 1, 0)]
    # what the tries promise is measured on other pairs, and codes are added until it holds
    one, two = pairs_at(dim, threshold, 4 * TRIALS, 1)
    codes, missed = [], np.ones(4 * TRIALS, dtype=bool)
    while len(codes) < best[3] or missed.mean() > (1 - recall) / 2:
        codes.append(ProductCode(dim, best[1], best[2], len(codes)))
        left = np.flatnonzero(missed)
        if len(left):
            (i, a), (j, b) = codes[-1].decode(one[left]), codes[-1].decode(two[left])
            missed[left[[k for k, _ in set(zip(i.tolist(), a.tolist())) & set(zip(j.tolist(), b.tolist()))]]] = False
    return codes


def _units(x: np.ndarray) -> np.ndarray:
    """Directions in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(raw: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def _rows(lists: pa.ListArray, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length: their places, and a matrix of them; none that is
    null, empty, zero, or holds what is null or not finite."""
    flat = lists.values
    offsets = lists.offsets.to_numpy()
    numbers = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
    valid = ~lists.is_null().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(offsets), 0)
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        x = numbers[offsets[at][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1) & x.any(1)
        if good.any():
            yield at[good], x[good]


def _read(kind: type):
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            raws: list[bytes | None] = [None] * batch.num_rows
            for at, x in _rows(batch.column(1), kind):
                for i, unit, raw in zip(at.tolist(), _units(x) + 0.0, x):  # + 0.0 makes -0 a 0
                    keys[i], raws[i] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest(), raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    return run


def sketches(units: np.ndarray) -> np.ndarray:
    """Rows of bytes: a scale, the length of what rounding loses, and each
    component rounded to one of 15 steps, two a byte."""
    scale = np.abs(units).max(1, keepdims=True) / 7
    steps = np.rint(units / scale)
    # the bound is rounded up to what single precision holds
    lost = np.nextafter((np.linalg.norm(units - steps.astype(np.float32) * scale.astype(np.float32), axis=1, keepdims=True) * (1 + 1e-6) + 1e-9).astype(np.float32), np.float32(4))
    half = (steps + 8).astype(np.uint8)
    if half.shape[1] % 2:
        half = np.hstack([half, np.full((len(half), 1), 8, dtype=np.uint8)])
    head = np.hstack([scale.astype(np.float32), lost]).view(np.uint8)
    return np.hstack([head, half[:, ::2] << 4 | half[:, 1::2]])


def _rough(sketch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = _matrix(sketch, np.uint8)
    head, body = np.ascontiguousarray(x[:, :8]).view(np.float32), x[:, 8:]
    steps = np.stack([body >> 4, body & 15], axis=2).reshape(len(x), -1).astype(np.float32) - 8
    return steps * head[:, :1], head[:, 1]


def likely(threshold: float):
    """Whether rounded vectors are so near that their vectors may reach the threshold."""

    def run(one: list[bytes], two: list[bytes]) -> np.ndarray:
        a, lost_a = _rough(one)
        b, lost_b = (a, lost_a) if one is two else _rough(two)
        slack = lost_a[:, None] + (1 + lost_a[:, None]) * lost_b[None, :]
        return a @ b.T >= threshold - slack - 1e-4

    return run


def near(threshold: float, kind: type):
    """Whether cosines in double precision reach the threshold."""

    def run(one: list[bytes], two: list[bytes]) -> np.ndarray:
        a = _units(_matrix(one, kind))
        return a @ (a if one is two else _units(_matrix(two, kind))).T >= threshold

    return run


def _capped(codes: dict[int, list[ProductCode]], kind: type, names: list[str]):
    """Adds each vector's caps and sketch."""
    place = names.index("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(place).to_pylist()
            caps: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(raw)
            rough: list[bytes] = [b""] * len(raw)
            for size in sorted({len(r) for r in raw}):
                who = [i for i, r in enumerate(raw) if len(r) == size]
                units = _units(_matrix([raw[i] for i in who], kind))
                found = [code.decode(units) for code in codes[units.shape[1]]]
                row, cap = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")
                parts = np.split(cap[order], np.searchsorted(row[order], np.arange(1, len(who))))
                for i, own, line in zip(who, parts, sketches(units)):
                    caps[i], rough[i] = own, line.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(caps, pa.list_(pa.int64())), pa.array(rough, pa.binary())], names=[*names, "buckets", "sketch"])

    return run


def cap_join(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """Links between vectors whose cosine is at least ``threshold``, whatever their labels.

    Returns ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable by links) and ``kept`` (whether that
    is the row's own), one row for each row of ``vectors``.

    Equal directions are one class, which is weighed and not expanded. Each
    class is list-decoded once to all caps that hold it. Vectors that share a cap
    are compared: first rounded to half a byte a component, with a bound that loses
    nothing, then, where that leaves a link possible, in double precision, each
    pair in the first cap that it shares (see ``join_by_buckets``).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do rows with a null id (whose ids stay null). Vectors
    of different lengths never link. Repeated rows are copies of each other; rows
    that share an id are one node of the components. Other columns are ignored.
    An empty table gives an empty result.
    """
    tune(vectors.sparkSession)
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding"))
    read = stash(wide.mapInArrow(_read(kind), "vec_id long, key binary, raw binary"), "vectors")
    valid = F.col("vec_id").isNotNull() & F.col("key").isNotNull()
    classes = stash(read.where(valid).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw")), "directions")
    size = F.octet_length("raw")
    lengths = classes.groupBy((size / np.dtype(kind).itemsize).cast("int").alias("dim")).count().collect()  # a row a vector length
    codes = {r["dim"]: codes_for(r["dim"], r["count"], threshold, recall) for r in lengths}
    rows = classes.select("key", "rep", "n", size.cast("long").alias("weight"), "raw")
    capped = rows.mapInArrow(_capped(codes, kind, rows.columns), "key binary, rep long, n long, weight long, raw binary, buckets array<long>, sketch binary")

    def with_raw(going: DataFrame) -> DataFrame:
        return going.join(classes.select(F.col("key").alias("of"), F.col("raw").alias("data")), F.col("key") == F.col("of")).drop("of")

    told = join_by_buckets(stash(capped.drop("raw"), "capped"), likely(threshold), with_raw, near(threshold, kind))
    own = read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(told, F.col("key") == F.col("class_key"), "left")
    component = F.coalesce("component", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
