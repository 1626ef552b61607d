"""Joins of rows that share a bucket: sketches first, then exact checks, in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .graph import components
from .groups import by_group

#: Members of one block; two blocks meet in one task. Sketches are small, so
#: their blocks are larger; a block of exact data is bounded by its weight too.
SKETCH_ROWS, EXACT_ROWS, EXACT_WEIGHT = 4096, 1024, 1_000_000

#: Values of rows (first list) against columns (second list), as a matrix of truths.
Test = Callable[[list[bytes], list[bytes]], np.ndarray]


def _blocked(df: DataFrame, columns: list[str]) -> DataFrame:
    """A copy of each row for each two blocks of a bucket of which one holds it."""
    each = df.select(*columns, F.explode("where").alias("at"))
    each = each.select(*columns, F.col("at.bucket").alias("bucket"), F.col("at.blocks").alias("blocks"), F.pmod(F.xxhash64("key"), F.col("at.blocks")).cast("int").alias("own"))
    met = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*columns, "bucket", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def _sides(rows: dict[str, list]) -> tuple[list[int], list[int]]:
    """The members that are compared with each other: all of a block, or two blocks."""
    if rows["bi"][0] == rows["bj"][0]:
        every = list(range(len(rows["own"])))
        return every, every
    first = rows["bi"][0]
    return [i for i, x in enumerate(rows["own"]) if x == first], [i for i, x in enumerate(rows["own"]) if x != first]


def _true(test: Test, values: list[bytes], one: list[int], two: list[int]) -> np.ndarray:
    left = [values[i] for i in one]
    found = test(left, left if one is two else [values[i] for i in two])
    if one is two:
        np.fill_diagonal(found, False)
    return found


def _likely(test: Test):
    """Members of a bucket that have a likely partner in this block or these two."""

    def run(rows: dict[str, list]) -> dict[str, list] | None:
        one, two = _sides(rows)
        if not one or not two or len(rows["own"]) < 2:
            return None
        found = _true(test, rows["sketch"], one, two)
        some = {one[i] for i in np.flatnonzero(found.any(1))} | {two[i] for i in np.flatnonzero(found.any(0))}
        return {"key": [rows["key"][i] for i in sorted(some)], "bucket": [rows["bucket"][0]] * len(some)} if some else None

    return run


def _met_before(mine: list[list[int]], one: np.ndarray, two: np.ndarray, bucket: int) -> np.ndarray:
    """Whether a member of ``one`` and one of ``two`` share a bucket of a smaller number."""
    who = np.repeat(np.arange(len(mine)), [len(m) for m in mine])
    what = np.array([b for m in mine for b in m], dtype=np.int64)
    who, what = who[what < bucket], what[what < bucket]
    ids, place = np.unique(what, return_inverse=True)
    met = np.zeros((len(one), len(two)), dtype=np.float32)
    for start in range(0, len(ids), 2048):
        part = (place >= start) & (place < start + 2048)
        member = np.zeros((len(mine), 2048), dtype=np.float32)
        member[who[part], place[part] - start] = 1
        met += member[one] @ member[two].T
    return met > 0


def _linked(test: Test):
    """Links within a block or between two, of pairs that share no smaller bucket."""

    def run(rows: dict[str, list]) -> dict[str, list] | None:
        seen, keep = set(), []
        for i, key in enumerate(rows["key"]):  # repeated rows
            if key not in seen:
                seen.add(key)
                keep.append(i)
        rows = {c: [v[i] for i in keep] for c, v in rows.items()}
        one, two = _sides(rows)
        if not one or not two or len(keep) < 2:
            return None
        near = _true(test, rows["data"], one, two)
        left, right = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(left):
            return None
        near = near[np.ix_(left, right)]
        a, b = np.array(one)[left], np.array(two)[right]
        hit = np.unique(np.concatenate([a, b]))
        at = {x: i for i, x in enumerate(hit.tolist())}
        a, b = np.array([at[x] for x in a.tolist()]), np.array([at[x] for x in b.tolist()])
        near &= ~_met_before([rows["mine"][i] for i in hit], a, b, rows["bucket"][0])
        counts, reps = np.array(rows["n"], dtype=np.int64)[hit], np.array(rows["rep"], dtype=np.int64)[hit]
        links = np.zeros(len(hit), dtype=np.int64)
        links[a] += near @ counts[b]
        if one is not two:
            links[b] += near.T @ counts[a]
        # the smallest rep that links of these blocks reach
        label, last = reps.copy(), np.iinfo(np.int64).max
        while True:
            least = label.copy()
            np.minimum.at(least, a, np.where(near, label[b][None, :], last).min(1))
            np.minimum.at(least, b, np.where(near, least[a][:, None], last).min(0))
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(links)
        return {"key": [rows["key"][i] for i in hit[some]], "rep": reps[some].tolist(), "links": links[some].tolist(), "root": label[some].tolist()} if len(some) else None

    return run


def join_by_buckets(members: DataFrame, likely: Test, exact: Callable[[DataFrame], DataFrame], near: Test) -> DataFrame:
    """Exact links between classes that share a bucket.

    ``members`` is a written table of classes: ``key`` (16 bytes), ``rep`` (the
    smallest id), ``n`` (rows), ``weight`` (of its exact data), ``sketch`` and
    ``buckets`` (array of longs, each at most once). ``likely`` tells from two
    lists of sketches whether links are possible; ``exact`` adds ``data`` to rows
    that have ``key`` and ``rep``; ``near`` decides by the data. Returns a row
    for each class: (class_key, rep, n_links, component), where ``n_links``
    counts other rows of the class and linked rows of other classes, and
    ``component`` is the smallest rep that links reach. Classes with the same rep
    are one node.

    Buckets with the same members are one (told by two 64-bit fingerprints and
    the count). A bucket is cut into blocks and each two blocks meet in one
    task, first with sketches only. Members without a likely partner in a
    bucket go no further, so exact data are sent only where links are likely.
    A pair counts in the smallest bucket that its members share. Pairs are never
    rows: tasks return counts and a spanning forest.
    """
    entries = members.select("key", F.explode("buckets").alias("bucket"))
    print_of = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), *print_of).where("n > 1")
    shared = shared.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    shared = stash(shared.select("bucket", F.ceil(F.col("n") / SKETCH_ROWS).cast("int").alias("blocks")), "buckets")
    placed = entries.join(shared, "bucket").groupBy("key").agg(F.collect_list(F.struct("bucket", "blocks")).alias("where"))
    held = stash(members.drop("buckets").join(placed, "key"), "members")

    met = _blocked(held, ["key", "sketch"])
    some = by_group(met, ["bucket", "bi", "bj"], _likely(likely), "key binary, bucket long", pa.schema([("key", pa.binary()), ("bucket", pa.int64())]))
    some = stash(some.distinct(), "likely")
    weighed = some.join(held.select("key", "weight"), "key")
    # a written table, so that a large bucket's join may be split
    blocks = stash(weighed.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / EXACT_ROWS), F.ceil(F.sum("weight") / EXACT_WEIGHT), F.lit(1)).cast("int").alias("blocks")), "blocks")
    going = some.join(blocks, "bucket").groupBy("key").agg(F.collect_list(F.struct("bucket", "blocks")).alias("where"))
    mine = held.select("key", "rep", "n", F.col("where.bucket").alias("mine"))
    ready = exact(going.join(mine, "key"))
    out = pa.schema([("key", pa.binary()), ("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    links = stash(by_group(_blocked(ready, ["key", "rep", "n", "mine", "data"]), ["bucket", "bi", "bj"], _linked(near), "key binary, rep long, links long, root long", out), "links")
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy(F.col("key").alias("of")).agg(F.sum("links").alias("links"))
    told = members.select("key", "rep", "n").join(counted, F.col("key") == F.col("of"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    return stash(told.select(F.col("key").alias("class_key"), "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "told")
