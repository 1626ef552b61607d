"""N-gram Jaccard join: MinHash banding, then exact checks on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import join_by_buckets
from .common import stash, tune

WORD = re.compile(r"\w+")
#: Bytes of a sketch, and by how many standard deviations a pair at the threshold
#: may fall short of it there: of 30,000 such pairs one does by more.
PLACES, DEVIATIONS = 256, 4.0
#: Words whose hashes a worker remembers.
CACHE = 500_000
_seen: dict[str, int] = {}
_U = np.uint64


def bands_for(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows a band: the most selective rows whose band count still
    finds a pair at ``threshold`` with probability ``recall``, by at most 100
    hash functions (``most`` if none of those do)."""
    best = (0, 0)
    for limit in (100, most):
        for rows in range(1, 17):
            bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
            if bands * rows <= limit:
                best = (bands, rows)
        if best[0]:
            return best
    raise ValueError("no banding reaches this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` lower-case words.

    A text of fewer words, but at least one, is a single shorter run. A text
    without words has none.
    """
    global _seen
    hashed = []
    for w in WORD.findall((text or "").lower()):
        h = _seen.get(w)
        if h is None:
            if len(_seen) >= CACHE:
                _seen = {}
            h = _seen[w] = xxhash.xxh64_intdigest(w)
        hashed.append(h)
    words = np.array(hashed, dtype=np.uint64)
    k = min(n, len(words))
    if not k:
        return words
    runs = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        runs = runs * _U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
        runs ^= runs >> _U(29)
    return np.unique(_mix(runs))


def signature(found: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit hash for each band of ``rows`` minimum hashes."""
    rng = np.random.default_rng(20_240_501)
    k = bands * rows
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)
    low = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 2048):
        part = found[i : i + 2048, None] * a + b
        low = np.minimum(low, (part ^ (part >> _U(32))).min(0))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64).tolist()


def sketch(found: np.ndarray) -> bytes:
    """One byte for each of PLACES ranges of hashes: 0 if the set has none there,
    else a digest of the smallest one."""
    starts = np.searchsorted(found, np.arange(PLACES, dtype=np.uint64) * _U(2**64 // PLACES))
    out = np.zeros(PLACES, dtype=np.uint8)
    some = np.flatnonzero(np.diff(starts, append=len(found)))
    out[some] = 1 + found[starts[some]] % _U(255)
    return out.tobytes()


def likely(threshold: float):
    """Whether sketches agree as often as those of sets at ``threshold`` do, less
    DEVIATIONS standard deviations."""

    def run(one: list[bytes], two: list[bytes]) -> np.ndarray:
        a = np.frombuffer(b"".join(one), dtype=np.uint8).reshape(len(one), PLACES)
        b = a if one is two else np.frombuffer(b"".join(two), dtype=np.uint8).reshape(len(two), PLACES)
        either = PLACES - (a == 0).astype(np.float32) @ (b == 0).astype(np.float32).T
        least = threshold * either - DEVIATIONS * np.sqrt(threshold * (1 - threshold) * either)
        out = np.empty(either.shape, dtype=bool)
        for i in range(len(a)):
            some = np.flatnonzero(a[i])
            out[i] = (b[:, some] == a[i, some]).sum(1) >= least[i]
        return out

    return run


def _signatures(n: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles((t or b"").decode("utf-8", "replace"), n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([signature(s, bands, rows) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                schema=schema,
            )

    return run


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sets(n: int, names: list[str]):
    """Replaces texts by their sets, and leaves out rows that are not of the class
    (their id is that of another text too) or repeat it."""
    place, text = names.index("key"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            keep, sets = [], []
            for key, t in zip(batch.column(place).to_pylist(), batch.column(text).to_pylist()):
                found = None if key in told else shingles((t or b"").decode("utf-8", "replace"), n)
                keep.append(found is not None and _key(found) == key)
                if keep[-1]:
                    told.add(key)
                    sets.append(found.tobytes())
            left = batch.filter(pa.array(keep, pa.bool_()))
            columns = [pa.array(sets, pa.binary()) if i == text else left.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:text], "data", *names[text + 1 :]])

    return run


def near(threshold: float):
    """Whether the Jaccard similarity of two sets is at least ``threshold``."""

    def run(one: list[bytes], two: list[bytes]) -> np.ndarray:
        every = [np.frombuffer(x, dtype=np.uint64) for x in (one if one is two else one + two)]
        sizes = np.array([len(s) for s in every])
        _, places, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        number = np.cumsum(counts > 1) - 1
        keep = (counts > 1)[places]
        who, what = np.repeat(np.arange(len(every)), sizes)[keep], number[places][keep]
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        last = int(what[-1]) + 1 if len(what) else 0
        width, first = min(4096, max(1, last)), len(one)
        common = np.zeros((first, len(two)), dtype=np.float32)
        for start in range(0, last, width):
            low, high = np.searchsorted(what, (start, start + width))
            dense = np.zeros((len(every), width), dtype=np.float32)
            dense[who[low:high], what[low:high] - start] = 1
            common += dense[:first] @ (dense if one is two else dense[first:]).T
        union = sizes[:first, None] + (sizes if one is two else sizes[first:])[None, :] - common
        return common >= threshold * union - 1e-9

    return run


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Documents whose word ``n``-gram sets have a Jaccard similarity of at least ``threshold``.

    Returns one row for each row of ``docs``: ``doc_id``; ``class_id``, the
    smallest id whose n-gram set is the same; ``n_links``, the number of other
    rows linked directly; ``group_id``, the smallest id reachable by links; and
    ``kept``, whether this is that document.

    Equal n-gram sets are one class, which is weighed, never expanded into
    pairs. Classes that share a band hash are compared: first by sketches of 256
    bytes, then, where those agree, by full n-gram sets, each pair in the first
    band hash that it shares (see ``join_by_buckets``). A pair at the threshold is
    found with probability ``recall`` or more, all found pairs are exact.

    Nulls and edge cases: a null text counts as empty; texts without words link
    with nothing; a row with a null id links with nothing and has null ids.
    Repeated rows count as copies of each other; rows that share an id are one
    node of the groups, whatever their texts. Very long texts are taken whole;
    one text's set must fit into a task's memory. Columns beside ``doc_id`` and
    ``text`` are ignored. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sig = stash(base.mapInArrow(_signatures(n, bands, rows), "doc_id long, key binary, n_shingles int, bands array<long>, sketch binary"), "signatures")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # everything but the id and the count is the same in all rows of a class
    classes = sig.where(usable).groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").cast("long").alias("weight"), F.first("bands").alias("buckets"), F.first("sketch").alias("sketch")
    )

    def with_sets(going: DataFrame) -> DataFrame:
        joined = going.join(base, F.col("rep") == F.col("doc_id")).select("key", "rep", "n", "mine", "where", "text")
        return joined.mapInArrow(_sets(n, joined.columns), "key binary, rep long, n long, mine array<long>, where array<struct<bucket:long,blocks:int>>, data binary")

    told = join_by_buckets(stash(classes, "classes"), likely(threshold), with_sets, near(threshold))
    rows_in = sig.select("doc_id", F.when(usable, F.col("key")).alias("key"))
    group = F.coalesce("component", "doc_id")
    return rows_in.join(told, F.col("key") == F.col("class_key"), "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        group.alias("group_id"),
        F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"),
    )
