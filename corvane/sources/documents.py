"""Documents: where they come from, what they must hold, what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

COLUMNS = ("document_id", "content", "mime_type", "size", "tenant_id", "source_uri", "language", "metadata", "created_at", "updated_at", "fingerprint")


def documents_from(
    df: DataFrame,
    document_id: Column | str,
    content: Column | str,
    mime_type: Column | str | None = None,
    tenant_id: Column | str | None = None,
    source_uri: Column | str | None = None,
    language: Column | str | None = None,
    metadata: Column | str | None = None,
    created_at: Column | str | None = None,
    updated_at: Column | str | None = None,
) -> DataFrame:
    """Rows of ``df`` as documents; a null or empty id and a null content are errors.

    A given tenant or language must not be empty either. The mime type is
    ``text/plain`` and the language ``en`` unless given; the size is in bytes;
    both times are now unless given.
    """

    def get(c: Column | str | None, default: Column) -> Column:
        return default if c is None else F.col(c) if isinstance(c, str) else c

    def checked(c: Column, what: str) -> Column:
        return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.raise_error(F.lit(f"{what} must not be empty"))).otherwise(c)

    text = get(content, F.lit(None))
    body = F.when(text.isNull(), F.raise_error(F.lit("content must not be null"))).otherwise(text)
    mime = F.coalesce(F.nullif(get(mime_type, F.lit(None).cast("string")), F.lit("")), F.lit("text/plain"))
    return df.select(
        checked(get(document_id, F.lit(None)).cast("string"), "document_id").alias("document_id"),
        body.alias("content"),
        mime.alias("mime_type"),
        F.octet_length(text).cast("long").alias("size"),
        (F.lit(None).cast("string") if tenant_id is None else checked(get(tenant_id, F.lit(None)), "tenant_id")).alias("tenant_id"),
        get(source_uri, F.lit(None).cast("string")).alias("source_uri"),
        (F.lit("en") if language is None else checked(get(language, F.lit(None)), "language")).alias("language"),
        get(metadata, F.parse_json(F.lit("{}"))).alias("metadata"),
        get(created_at, F.current_timestamp()).alias("created_at"),
        get(updated_at, F.current_timestamp()).alias("updated_at"),
        expr.fingerprint(text).alias("fingerprint"),
    )


def read_text(spark: SparkSession, path: str, mime_type: str = "text/plain") -> DataFrame:
    """Whole files as documents; the id and the source are their paths."""
    files = spark.read.text(path, wholetext=True)
    return documents_from(files, F.col("_metadata.file_path"), "value", F.lit(mime_type), source_uri=F.col("_metadata.file_path"))


def read_binary(spark: SparkSession, path: str, mime_type: str = "application/octet-stream", **options) -> DataFrame:
    """Binary files as documents; bytes are taken as text without validation."""
    reader = spark.read.format("binaryFile")
    for k, v in options.items():
        reader = reader.option(k, v)
    files = reader.load(path)
    return documents_from(files, "path", F.col("content").cast("string"), F.lit(mime_type), source_uri="path", updated_at="modificationTime").withColumn("size", F.octet_length("content").cast("long"))


def read_stream_of_files(spark: SparkSession, path: str, mime_type: str = "text/plain") -> DataFrame:
    """A lazily read source: nothing is opened before an action, and each action opens it again."""
    return read_text(spark, path, mime_type)


def changed(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that ``stored`` (document_id, fingerprint) does not already hold as they are."""
    return documents.join(stored.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")
