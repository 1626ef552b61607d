"""Connected components over an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Rounds are logarithmic in the component size; this only stops a defect from looping.
MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node id of each node's component: rows (node, component).

    ``edges`` holds undirected links between integer ids; loops, repeats and
    nulls are allowed and carry nothing. Nodes without links are absent from
    the result. An empty edge table gives an empty result.

    Alternating star contraction: the large-star step hangs a node's larger
    neighbours on its smallest neighbour, the small-star step hangs the node
    itself and its smaller neighbours there. Each step is one map-side combined
    minimum and one join; a hub's rows are never needed together, so a skewed
    join may split them. Every round is written to the shared folder.
    """
    now = stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "lows")
        # every larger neighbour v of u hangs on m
        large = stash(both.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        hung = large.join(low, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(hung.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
