"""Session settings, shared storage and small column helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so batches are kept short.
ARROW_ROWS = 512
#: Folders that this process has written and not deleted.
_written: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Set the session up for rows that hold whole texts."""
    # a session started from another folder still finds this package in its Python workers
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session, whose executors are the driver, uses a
    temporary folder; on a cluster that would lose data, so it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/corvane-checkpoints"
    return path.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage without relying on any executor: the files outlive
    every task that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``stash`` what ``make`` returns, and delete what was written to make it."""
    before = len(_written)
    out = stash(make(), label)
    for path in _written[before:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _written[before:-1]
    return out


def whole_text(name: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, order: str, size: int) -> DataFrame:
    """Different rows, about ``size`` of them, or all if there are no more.

    ``order`` is a 64-bit hash of whatever tells rows apart; rows that have the
    same are one. Those below the share that gives ``size`` stay, and the
    smallest one whatever the share, so a table that has rows is never sampled
    to nothing. A filter and a map-side combined aggregate: nothing is sorted.
    """
    n, least = df.agg(F.approx_count_distinct(order, 0.01), F.min(order)).first()
    some = df if n <= size else df.where(F.col(order) <= max(least, int(-(2**63) + 2**64 * (size / n))))
    return some.dropDuplicates([order])
