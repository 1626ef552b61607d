"""A chunk store on Parquet: upsert, exact search, delete."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import expr
from ..functions.expr import MetadataFilter

#: Used where a caller gives no or a negative number of results.
DEFAULT_TOP_K = 10


class VectorStore(Protocol):
    """What pipelines need of a store."""

    def store(self, chunks: DataFrame) -> None: ...
    def chunks(self) -> DataFrame: ...
    def delete(self, unit_ids: Sequence[str]) -> None: ...


def latest(chunks: DataFrame, key: str = "unit_id", order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, or any."""
    rest = [c for c in chunks.columns if c != key]
    row = F.struct(*rest)
    pick = F.max_by(row, F.col(order)) if order else F.any_value(row)
    return chunks.groupBy(key).agg(pick.alias("row")).select(key, "row.*").select(*chunks.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str = "unit_id", order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new``, which win; within ``new`` the last by
    ``order`` wins. One anti join: kept rows are not shuffled where the new keys
    are few enough for Spark to broadcast them."""
    new = latest(new, key, order)
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(existing: DataFrame, ids: DataFrame, key: str = "unit_id") -> DataFrame:
    """Without the rows whose key is in ``ids``; ids that are missing do nothing."""
    return existing.join(ids.select(key).distinct(), key, "left_anti")


def search(chunks: DataFrame, vector: Sequence[float], top_k: int, filters: Sequence[MetadataFilter] = (), threshold: float | None = None) -> DataFrame:
    """The ``top_k`` chunks nearest to one vector by cosine, with ``score``.

    Filters come before scoring, and as scan predicates where the field is a
    column. Chunks without a vector are left out; of other lengths they score 0.
    Ties go by ``unit_id``. Zero or fewer results give none.
    """
    query = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
    size = sum(float(x) ** 2 for x in vector) ** 0.5
    norm = F.col("norm") if "norm" in chunks.columns else None
    scored = chunks.where(expr.match_all(filters, chunks.columns)).where("vector is not null").withColumn("score", expr.cosine("vector", query, norm, F.lit(size)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "unit_id").limit(max(0, top_k))


class ConcurrentChange(RuntimeError):
    """Another writer changed the store since it was read; open it again and repeat."""


class TableStore:
    """Chunks under one folder, seen as a view of the session.

    Chunks are kept in buckets by a hash of their document. A change writes the new
    rows, and anew what remains of the buckets that it touches, beside everything
    else; then it adds the next line to a log, which says where each bucket is.
    Readers never see a half-written state, a later session finds the last
    version, and of two writers that begin from the same version one fails.
    """

    def __init__(self, spark: SparkSession, table: str = "chunks", location: str | None = None, buckets: int = 32):
        if not re.fullmatch(r"\w+", table):
            raise ValueError(f"not a table name: {table}")
        self.spark, self.table, self.n_buckets = spark, table, buckets
        self.location = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}_versions"
        self.number, self.schema = 0, None
        self.paths: dict[int, list[str]] = {}
        place = self._place("log")
        self.files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        lines = sorted((int(x.getPath().getName()), x.getPath().toString()) for x in self.files.listStatus(place)) if self.files.exists(place) else []
        for number, path in reversed(lines):
            text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
            if text:  # a writer that died left an empty line
                said = json.loads(text)
                self.schema = StructType.fromJson(said["schema"])
                self.n_buckets = said["buckets"]
                self.paths = {int(b): p for b, p in said["paths"].items()}
                break
        if lines:
            self.number = lines[-1][0]
        if self.schema is not None:
            self.chunks().createOrReplaceTempView(table)
        else:
            spark.catalog.dropTempView(table)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")

    def ensure(self, schema: str) -> None:
        """Begin empty where nothing is stored yet."""
        if self.schema is None:
            self._change(self.spark.createDataFrame([], schema), {}, set())

    def _bucket(self, columns: Sequence[str]) -> Column:
        key = "source_doc_id" if "source_doc_id" in columns else "unit_id"
        return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(self.n_buckets)).cast("int")

    def _write(self, df: DataFrame) -> tuple[str, list[int]]:
        """Rows by bucket; where they are, and which buckets they have."""
        path = uuid.uuid4().hex
        # partitions of a bucket are as large as Spark advises, not one a bucket
        df.withColumn("_bucket", self._bucket(df.columns)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.location}/{path}")
        names = [x.getPath().getName() for x in self.files.listStatus(self._place(path)) if x.isDirectory()]
        return path, sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))

    def _change(self, schema_of: DataFrame, new: dict[int, list[str]], touched: set[int]) -> None:
        """Log the version in which the touched buckets are where ``new`` says."""
        schema = schema_of.schema
        paths = {b: p for b, p in self.paths.items() if b not in touched} | new
        text = json.dumps({"schema": json.loads(schema.json()), "buckets": self.n_buckets, "paths": paths})
        line = self._place(f"log/{self.number + 1:012d}")
        try:
            out = self.files.create(line, False)
        except Py4JJavaError as e:
            raise ConcurrentChange(f"version {self.number + 1} of {self.table} was written by another") from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.number, self.schema, self.paths = self.number + 1, schema, paths
        self.chunks().createOrReplaceTempView(self.table)

    def _read(self, buckets: Iterable[int]) -> DataFrame:
        places = [f"{self.location}/{p}" for b in sorted(buckets) for p in self.paths.get(b, [])]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def chunks(self) -> DataFrame:
        if self.schema is None:
            raise LookupError(f"nothing is stored in {self.table}")
        return self._read(self.paths)

    def _with(self, chunks: DataFrame, gone_by: str) -> None:
        """Add chunks in the place of those that share ``gone_by`` with them."""
        path, fresh = self._write(latest(chunks))
        new = {b: [f"{path}/_bucket={b}"] for b in fresh}
        if self.schema is None:
            return self._change(chunks, new, set(fresh))
        added = self.spark.read.schema(chunks.schema).parquet(*(f"{self.location}/{p[0]}" for p in new.values())) if new else chunks.limit(0)
        both = self._read([]).unionByName(chunks.limit(0), allowMissingColumns=True)
        touched = set(fresh) | (set() if gone_by == "source_doc_id" else self._holding(added.select("unit_id"), "unit_id"))
        self._rest(delete(self._read(touched), added.select(gone_by), gone_by), both, new, touched)

    def _holding(self, ids: DataFrame, key: str) -> set[int]:
        """Buckets that have rows with these keys; only the keys are read."""
        rows = self.chunks().join(ids.distinct(), key, "left_semi")
        return {r[0] for r in rows.select(self._bucket(self.schema.names)).distinct().collect()}

    def _rest(self, left: DataFrame, schema_of: DataFrame, new: dict[int, list[str]], touched: set[int]) -> None:
        path, kept = self._write(left)
        paths = {b: [*([f"{path}/_bucket={b}"] if b in kept else []), *new.get(b, [])] for b in touched}
        self._change(schema_of, {b: p for b, p in paths.items() if p}, touched)

    def store(self, chunks: DataFrame) -> None:
        """Insert or replace by ``unit_id``."""
        self._with(chunks, "unit_id")

    def replace_documents(self, chunks: DataFrame) -> None:
        """Store the chunks of documents whose earlier chunks all go first, so that a
        shorter version leaves none behind."""
        self._with(chunks, "source_doc_id")

    def search(self, vector: Sequence[float], top_k: int, filters: Sequence[MetadataFilter] = ()) -> DataFrame:
        return search(self.chunks(), vector, top_k, filters)

    def _without(self, ids: DataFrame, key: str) -> None:
        touched = self._holding(ids, key)
        if touched:
            self._rest(delete(self._read(touched), ids, key), self._read([]), {}, touched)

    def delete(self, unit_ids: Sequence[str]) -> None:
        if unit_ids:
            self._without(self.spark.createDataFrame([(i,) for i in unit_ids], "unit_id string"), "unit_id")

    def delete_documents(self, document_ids: Sequence[str]) -> None:
        if document_ids:
            self._without(self.spark.createDataFrame([(i,) for i in document_ids], "source_doc_id string"), "source_doc_id")

    def expire(self) -> None:
        """Delete what only earlier versions need; no reader may still use them."""
        used = {p.partition("/")[0] for places in self.paths.values() for p in places}
        for x in self.files.listStatus(self._place("")):
            name = x.getPath().getName()
            if re.fullmatch("[0-9a-f]{32}", name) and name not in used:
                self.files.delete(x.getPath(), True)
        for x in self.files.listStatus(self._place("log")):
            if int(x.getPath().getName()) < self.number:
                self.files.delete(x.getPath(), False)


def from_json_rows(rows: DataFrame) -> DataFrame:
    """Chunks from rows whose vector and metadata are JSON texts: rows with a
    damaged vector are left out, damaged metadata becomes null."""
    return (
        rows.withColumn("vector", expr.vector_from("vector"))
        .where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
        .withColumn("metadata", F.try_parse_json("metadata"))
    )


def to_json_rows(chunks: DataFrame) -> DataFrame:
    """The reverse: a null vector is ``[]``, null metadata ``{}``."""
    return chunks.withColumn("vector", expr.vector_literal("vector")).withColumn("metadata", F.coalesce(F.to_json("metadata"), F.lit("{}")))


def jdbc_predicate(f: MetadataFilter) -> str:
    """A filter on a JSONB column in a database's own SQL, to be pushed to it.

    Values compare as strings, as everywhere; an unknown operator matches nothing.
    """
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    field, many = quote(f.field), isinstance(f.value, (list, tuple, set))
    if f.op == "eq" and not many:
        value = str(f.value).lower() if isinstance(f.value, bool) else f.value
        return f"metadata ->> {field} = {quote(value)}"
    if f.op in ("in", "any_of") and many:
        listed = "ARRAY[" + ", ".join(quote(v) for v in f.value) + "]::text[]"
        return f"metadata ->> {field} = ANY({listed})" if f.op == "in" else f"metadata -> {field} ?| {listed}"
    return "FALSE"


def jdbc_search(spark: SparkSession, url: str, table: str, vector: Sequence[float], top_k: int, filters: Sequence[MetadataFilter] = (), **options) -> DataFrame:
    """The nearest chunks by a database's cosine distance, sorted and cut there."""
    k = top_k if top_k > 0 else DEFAULT_TOP_K
    return spark.read.format("jdbc").options(url=url, query=jdbc_query(table, vector, k, filters), **options).load()


def jdbc_query(table: str, vector: Sequence[float], top_k: int, filters: Sequence[MetadataFilter] = ()) -> str:
    """What ``jdbc_search`` asks."""
    if not re.fullmatch(r"\w+(\.\w+)?", table):
        raise ValueError(f"not a table name: {table}")
    where = " AND ".join(jdbc_predicate(f) for f in filters) or "TRUE"
    distance = f"vector <=> '[{','.join(repr(float(x)) for x in vector)}]'"
    return f"SELECT unit_id, source_doc_id, source_uri, text, metadata::text AS metadata, 1 - ({distance}) AS score FROM {table} WHERE {where} ORDER BY {distance}, unit_id LIMIT {int(top_k)}"


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Chunks in a database, for sessions that have its driver."""
    return from_json_rows(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def ddl(table: str, dimensions: int, dialect: str = "spark") -> str:
    """The statement that makes an empty chunk table where there is none."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    if not re.fullmatch(r"\w+(\.\w+)?", table):
        raise ValueError(f"not a table name: {table}")
    if dialect == "spark":
        return f"CREATE TABLE IF NOT EXISTS {table} (unit_id STRING, source_doc_id STRING, source_uri STRING, text STRING, metadata VARIANT, vector ARRAY<FLOAT>) USING parquet"
    if dialect == "pgvector":
        return f"CREATE TABLE IF NOT EXISTS {table} (unit_id TEXT PRIMARY KEY, source_doc_id TEXT NOT NULL, source_uri TEXT, text TEXT NOT NULL, metadata JSONB, vector vector({dimensions}))"
    if dialect == "sqlite":
        return f"CREATE TABLE IF NOT EXISTS {table} (unit_id TEXT PRIMARY KEY, source_doc_id TEXT NOT NULL, source_uri TEXT, text TEXT NOT NULL, metadata TEXT, vector TEXT)"
    raise ValueError(dialect)
