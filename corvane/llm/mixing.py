"""Mixing sources to target weights with distributed prefix sums. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, tune, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one range of hash keys holds on average.
RANGE_ROWS = 4096
KEY_BITS = 60


def words_in(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key(of: Column, seed: int, *more: Column) -> Column:
    """A uniform 60-bit number, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(of.cast("string"), F.lit("null")), F.lit(str(seed)), *more)), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in the order of ``by`` and numbered from 0 as ``number``, without one task for
    all: ranges are numbered by themselves, and the counts of the ranges before are added."""
    dealt = stash(rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by]).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").count()  # a row a range
    before = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in by])) - 1
    return dealt.withColumn("number", within).join(before, F.col("_part") == F.col("_of")).withColumn("number", F.col("number") + F.col("_before")).drop("_part", "_of", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds each source's weight and target to rows (source, source_size, n).

    Sources in code-point order, null last, take the weights in turn. Targets
    share ``share`` times all sizes by weight; none passes ``most`` times its
    source's size, and what that leaves over goes to the others by weight. In
    order of size per weight, the capped sources are a prefix, so one running
    sum finds where it ends. Sources of equal weight and size are one row of
    that sum, so many small sources are few rows. Everything stays in Spark.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = stash(numbered(sources, "source").withColumn("weight", turn).drop("number"), "sources")
    classes = weighed.groupBy("weight", "source_size").agg(F.count("*").alias("alike"))
    classes = classes.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("tightness", F.col("cap") / F.col("weight"))
    order = Window.orderBy("tightness", "weight", "source_size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size") * F.col("alike")).over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum(F.col("cap") * F.col("alike")).over(before), F.lit(0.0))) / F.sum(F.col("weight") * F.col("alike")).over(onward)
    told = (
        classes.withColumn("level", level)
        .withColumn("place", F.row_number().over(order))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("tightness"), F.struct("place", "level"))).over(everything)["level"])
        .select(F.col("weight").alias("_weight"), F.col("source_size").alias("_size"), F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))
    )
    return weighed.join(told, (F.col("weight") == F.col("_weight")) & (F.col("source_size") == F.col("_size"))).select("source", "source_size", "n", "target")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken`` and the columns named in ``carry``, one row for each row of
    ``docs``. A source's words are taken in whole epochs while its budget lasts;
    in the last epoch documents follow in the order of a hash of their id and
    text, and the document at the cut is taken in part, so that a source's words sum to
    the whole part of its target.

    Hash keys are range-partitioned within each source, into more ranges the
    more rows it has; sums of the ranges give each range its offset, and only a
    range is sorted in one task. A hot source is many ranges.

    A null text has no words; a null source is a source of its own and comes
    last; rows that share an id, or have none, have keys of their own if their
    texts differ; equal rows follow each other and may be taken differently but
    in the same amounts on every run. Texts are taken whole however long. With no words at all every target is 0. An empty table gives an
    empty result.
    """
    tune(docs.sparkSession)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(whole_text()).alias("size"), hash_key(F.col("doc_id"), seed, F.md5(whole_text())).alias("key"),
        *[F.col(c).alias(f"_{c}") for c in carry],
    )
    if not carry:
        sized = stash(sized, "sizes")
    sources = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most), "targets")
    own = sources.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"))
    placed = sized.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.floor(F.col("key") / float(2**KEY_BITS) * F.col("ranges")))
    sums = placed.groupBy("of", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("of").alias("at"), F.col("range").alias("at_range"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset"))
    offsets = stash(offsets, "offsets")
    within = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.sum("size").over(within) - F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.join(offsets, F.col("of").eqNullSafe(F.col("at")) & (F.col("range") == F.col("at_range"))).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_{c}").alias(c) for c in carry]
    )


def mixed_texts(docs: DataFrame, columns: list[str], **settings) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken.

    A document taken in part gives its first words, with the spaces between
    them. ``columns`` are those of ``docs``, in their order; ``n_chars`` is
    counted anew if it is one of them. A document without words is never taken.
    Nulls, long texts, repeated rows and empty tables are as in ``mix``.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*columns).alias("row"))
    taken = mix(rows, carry=("text", "row"), **settings).where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(left < F.col("size"), F.array_join(F.slice(parts, 1, left.cast("int")), "")).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
