"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .byte_bpe import Codec, byte_bpe
from .cap_filters import cap_join
from .common import table
from .licenses import license_scan
from .media_columns import media_columns
from .mixing import mix
from .ngram_join import ngram_join
from .pii import BASE, digest, find_pii
from .quality import quality
from .sharding import shard
from .toxicity import toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes, links and groups of all documents."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return digest(find_pii(table(spark, sf_dir, "documents")))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of ``op2_pii``: the base spans of all documents."""
    return op2_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and blocks in all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings."""
    return cap_join(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents"))


def shards_of_64_kib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit at which small tables are split too."""
    return shard(table(spark, sf_dir, "documents"), 64 << 10)


def token_digests(codec: Codec, ids: list[int]) -> dict:
    """Digests of a document's ids and of the bytes decoded from them."""
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(codec.decode(ids)).hexdigest(),
    }


DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    return byte_bpe(table(spark, sf_dir, "documents"), finish=token_digests, returns=DIGESTS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, from a model of the labelled ones."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as images, and features of what is read back."""
    return media_columns(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, from heuristic labellers of all documents."""
    return quality(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_pii": op2_pii,
        "pii_base": pii_base,
        "op3_license_scan": op3_license_scan,
        "op4_cap_filters": op4_cap_filters,
        "op5_sharding": op5_sharding,
        "shards_of_64_kib": shards_of_64_kib,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_media_columns": op9_media_columns,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
