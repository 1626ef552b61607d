"""Extendible hashing into shards of bounded bytes. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, tune, whole_text
from .mixing import KEY_BITS, hash_key

#: Bits that a round looks beyond those that evenly filled shards would need.
AHEAD = 4
SEED = 5


def shard(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """Deal documents to shards of at most ``limit`` bytes of text.

    A directory is indexed by the first bits of a 60-bit hash of the id. It
    starts as one bucket; a bucket above the limit, and only such a bucket, is
    split on its next bit. Returns ``doc_id``, ``bytes``, ``depth`` (bits that
    index its bucket), ``shard`` (those bits, then ``/`` and a page where one id
    fills more than a shard), ``shard_bytes`` and ``shard_docs``.

    Sizes are summed for cells of the hash space, a few times finer than the
    shards. All prefixes of all cells are summed at once; a cell's bucket is its
    shortest prefix within the limit. Cells that are still too large go through
    another, finer round by themselves.

    Rows that share all 60 bits (repeats of one id) cannot be split by hashing:
    they go to overflow pages within the limit, a row of more than half the
    limit to a page of its own. Only a single text above the limit exceeds it.
    A null text has no bytes; null ids hash alike; a long text counts whole; an
    empty table gives an empty result.
    """
    tune(docs.sparkSession)
    keyed = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole_text()).cast("long").alias("bytes"), hash_key(F.col("doc_id"), SEED).alias("h")), "keys")
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    rest, done = keyed, []
    while True:
        cells = stash(rest.groupBy(F.shiftright("h", KEY_BITS - high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
        spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        fits = spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
        found = spread.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("bucket"))
        directory = stash(cells.select("cell").join(found, "cell", "left"), "directory")
        placed = rest.withColumn("cell", F.shiftright("h", KEY_BITS - high)).join(directory, "cell")
        done.append(placed.where("bucket is not null").select("doc_id", "bytes", "bucket.*", F.lit(None).cast("long").alias("page")))
        if directory.where("bucket is null").isEmpty():
            break
        rest = stash(placed.where("bucket is null").select("doc_id", "bytes", "h"), "oversized")
        if high == KEY_BITS:
            done.append(_pages(rest, limit))
            break
        low, high = high + 1, min(KEY_BITS, high + 2 * AHEAD)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), F.concat(bits, F.coalesce(F.concat(F.lit("/"), F.col("page").cast("string")), F.lit(""))).alias("shard"), "shard_bytes", "shard_docs")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows whose hashes are equal.

    Rows of equal hash, id and bytes are one class. Prefix sums run over the
    classes of a hash, and a row's place within its class is its number in its
    partition after those of the partitions before; so however many rows share
    a hash, no task has to hold them.
    """
    half = max(1, limit // 2)
    rows = stash(rows.withColumn("part", F.spark_partition_id()), "overflow")
    of = ["h", "doc_id", "bytes"]
    parts = rows.groupBy(*of, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    classes = parts.groupBy(*of).agg(F.sum("n").alias("n")).withColumn("large", F.col("bytes") > limit // 2)
    ahead = Window.partitionBy("h", "large").orderBy("bytes", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(*of, "large", F.coalesce(F.sum(F.col("n") * F.col("bytes")).over(ahead), F.lit(0)).alias("offset"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    a, b = parts.alias("a"), classes.alias("b")
    starts = stash(a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in of]).select(*[F.col(f"a.{c}").alias(f"_{c}") for c in of], F.col("part").alias("_part"), "first", "large", "offset", "before"), "classes")
    own = F.row_number().over(Window.partitionBy(*of, "part").orderBy("part")) - 1
    at = rows.withColumn("own", own).join(starts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*of, "part")])
    number = F.col("first") + F.col("own")
    page = F.when(F.col("large"), -1 - F.col("before") - number).otherwise(F.floor((F.col("offset") + number * F.col("bytes")) / half))
    paged = stash(at.select("doc_id", "bytes", "h", page.cast("long").alias("page")), "paged")
    sums = paged.groupBy(F.col("h").alias("_h"), F.col("page").alias("_page")).agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return paged.join(sums, (F.col("h") == F.col("_h")) & (F.col("page") == F.col("_page"))).select("doc_id", "bytes", F.lit(KEY_BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", "shard_docs", "page")
