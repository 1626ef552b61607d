"""What a session needs to run this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Python workers of a session that was started elsewhere find this package."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


#: A session's setting: into how many parts documents are dealt as they are read.
PARTS = "corvane.documents.parts"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many parts as the session says, or as they were read.

    A file of one row group is one part, and whatever is computed for its rows
    runs on one core; whoever knows that the files are such can set PARTS.
    """
    parts = df.sparkSession.conf.get(PARTS, None)
    return df.repartition(int(parts)) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder of plain files that the driver and all executors see: under
    ``spark.checkpoint.dir``, or a temporary one where the executors are the driver."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp()
    at = urlsplit(place)
    if at.scheme not in ("", "file"):
        raise ValueError(f"not a folder of plain files: {place}")
    made = f"{(unquote(at.path) if at.scheme else place).rstrip('/')}/corvane-files-{uuid.uuid4().hex}"
    os.makedirs(made)
    return made
