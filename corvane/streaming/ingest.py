"""Documents that keep arriving: the chunkers are stateless, so they run unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr
from ..sources.store import TableStore


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_stream(documents: DataFrame, splitter: Callable[[DataFrame], DataFrame], store: TableStore, checkpoint: str, arrived: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Chunk what arrives and store it, each batch at once.

    A document whose content arrived before is skipped; with ``arrived``, the name
    of a timestamp column, what is remembered for that is bounded by ``late``. A
    batch that is repeated after a failure stores the same rows again.
    """
    marked = documents.withColumn("fingerprint", expr.fingerprint("content"))
    keys = ["document_id", "fingerprint"]
    fresh = marked.withWatermark(arrived, late).dropDuplicatesWithinWatermark(keys) if arrived else marked.dropDuplicates(keys)

    def keep(batch: DataFrame, _: int) -> None:
        store.replace_documents(splitter(batch))

    return fresh.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
