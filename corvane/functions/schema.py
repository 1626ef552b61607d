"""Schemas of the tables that operators exchange, and rows of them from Python values."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import SCORES
from .serde import POSITION

DOCUMENTS = "document_id string NOT NULL, content string, mime_type string, size bigint, tenant_id string, source_uri string, language string, metadata variant, created_at timestamp, updated_at timestamp, fingerprint binary"
CHUNKS = f"unit_id string, source_doc_id string, source_uri string, chunk_index int, text string, vector array<float>, scores {SCORES}, position {POSITION}, token_count int, parent_id string, window_text string, context_prefix string, tenant_id string, metadata variant"
FACTS = f"unit_id string, source_doc_id string, source_uri string, subject string, predicate string, object string, scores {SCORES}, metadata variant"
UNITS = f"query_id string, rank int, unit_type string, unit_id string, source_doc_id string, source_uri string, as_text string, score double, scores {SCORES}, parent_id string"
QUERIES = "query_id string, text string, tenant_id string, subject string, top_k int"


def rows(spark: SparkSession, schema: str, values: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows of one of the schemas; missing columns are null, metadata is any JSON value."""
    names = [f.strip().split(" ")[0] for f in _split(schema)]
    plain = schema.replace(" variant", " string")
    made = [tuple(json.dumps(v["metadata"]) if n == "metadata" and v.get(n) is not None else v.get(n) for n in names) for v in values]
    df = spark.createDataFrame(made, plain)
    return df.withColumn("metadata", F.parse_json("metadata")).select(*names) if "metadata" in names else df


def _split(schema: str) -> list[str]:
    """The fields of a schema, whose types may hold commas."""
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return out


def chunk_rows(spark: SparkSession, values: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Chunks from (unit_id, source_doc_id, text, ..)."""
    return rows(spark, CHUNKS, values)


def fact_rows(spark: SparkSession, values: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Facts from (unit_id, source_doc_id, subject, predicate, object, ..)."""
    return rows(spark, FACTS, values)


def query_rows(spark: SparkSession, values: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Queries from (query_id, text, ..)."""
    return rows(spark, QUERIES, values)
