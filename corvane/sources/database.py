"""Chunks in a database that Python reaches by its DB-API: upsert, search, delete."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import MetadataFilter
from . import store

#: Rows of one statement's batch, batches of one transaction, and row numbers that one task reads.
BATCH, COMMIT, PART = 500, 10, 8192
#: Parts that a table is read in at most.
MOST_PARTS = 4096
COLUMNS = ("unit_id", "source_doc_id", "source_uri", "text", "metadata", "vector")
#: How a dialect marks a value, and what it makes of the two columns that are texts here.
MARKS = {"pgvector": ("%s", "%s::jsonb", "%s::vector"), "sqlite": ("?", "?", "?")}


def upsert_statement(table: str, dialect: str) -> str:
    """Inserts a chunk, or replaces the one with its id."""
    mark, metadata, vector = MARKS[dialect]
    values = ", ".join({"metadata": metadata, "vector": vector}.get(c, mark) for c in COLUMNS)
    return f"INSERT INTO {table} ({', '.join(COLUMNS)}) VALUES ({values}) ON CONFLICT (unit_id) DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in COLUMNS[1:])


def delete_statement(table: str, dialect: str, column: str) -> str:
    return f"DELETE FROM {table} WHERE {column} = {MARKS[dialect][0]}"


def index_statement(table: str, dialect: str) -> str:
    """Makes the index by which documents are deleted, where there is none. Without
    it each of them is a scan of the table."""
    schema, _, name = table.rpartition(".")
    index = f"{name}_source_doc_id"
    if dialect == "sqlite" and schema:
        index, table = f"{schema}.{index}", name
    return f"CREATE INDEX IF NOT EXISTS {index} ON {table} (source_doc_id)"


def _batches(rows: Iterator[Any], make: Callable[[Any], tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(make(row))
        if len(held) == BATCH:
            yield held
            held = []
    if held:
        yield held


class DatabaseStore:
    """A chunk table in a database, for pipelines.

    ``connect`` opens a DB-API connection and travels to the executors; a file must
    be where all of them see it. Writes are batches of bound values, some of them a
    transaction; both statements give the same table when they are repeated, so a
    task may run again. ``writers`` bounds the connections that write at once.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any], table: str, dimensions: int, dialect: str = "pgvector", writers: int = 8):
        if dialect not in MARKS:
            raise ValueError(dialect)
        self.made = store.ddl(table, dimensions, dialect)
        self.spark, self.connect, self.table, self.dialect = spark, connect, table, dialect
        self.writers = 1 if dialect == "sqlite" else writers  # one file takes one writer

    def _run(self, statement: str, batches: Iterator[list[tuple]]) -> None:
        _execute(self.connect, statement, batches)

    def ensure(self) -> None:
        """The table and its index, where there are none."""
        for statement in (self.made, index_statement(self.table, self.dialect)):
            self._run(statement, iter([[()]]))

    def store(self, chunks: DataFrame) -> None:
        """Insert or replace by ``unit_id``; of rows that repeat an id, one stays."""
        have = set(chunks.columns)
        rows = chunks.select(*[F.col(c) if c in have else F.lit(None).cast({"metadata": "variant", "vector": "array<float>"}.get(c, "string")).alias(c) for c in COLUMNS])
        self._send(store.to_json_rows(rows), "unit_id", upsert_statement(self.table, self.dialect))

    def replace_documents(self, chunks: DataFrame) -> None:
        """The chunks of documents whose earlier chunks all go first."""
        self._send(chunks.select("source_doc_id").distinct(), "source_doc_id", delete_statement(self.table, self.dialect, "source_doc_id"))
        self.store(chunks)

    def _send(self, rows: DataFrame, key: str, statement: str) -> None:
        """Run the statement for each row. Rows of one key have one writer, so that
        two writers never wait for each other's."""
        connect = self.connect

        def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = (part.slice(at, BATCH) for part in parts for at in range(0, part.num_rows, BATCH))
            _execute(connect, statement, ([*zip(*(c.to_pylist() for c in x.columns), strict=True)] for x in cut))
            yield from ()

        dealt = rows.repartition(1) if self.writers == 1 else rows.repartition(self.writers, key)
        dealt.mapInArrow(write, "done boolean").collect()

    def delete(self, unit_ids: Sequence[str]) -> None:
        self._run(delete_statement(self.table, self.dialect, "unit_id"), _batches(iter(unit_ids), lambda i: (i,)))

    def delete_documents(self, document_ids: Sequence[str]) -> None:
        self._run(delete_statement(self.table, self.dialect, "source_doc_id"), _batches(iter(document_ids), lambda i: (i,)))

    def _read(self, query: str, names: Sequence[str], kinds: str, places: Sequence[str] = ("",)) -> DataFrame:
        """The rows of a query, fetched batch by batch by one task for each place."""
        connect = self.connect
        types = [pa.float64() if k.endswith(" double") else pa.string() for k in kinds.split(", ")]

        def fetch(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            connection = connect()
            try:
                for number in (n for batch in numbers for n in batch.column(0).to_pylist()):
                    cursor = connection.cursor()
                    cursor.execute(query + places[number])
                    while rows := cursor.fetchmany(BATCH):
                        columns = ([json.dumps(v) if isinstance(v, (dict, list)) else v for v in column] for column in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))
            finally:
                connection.close()

        return self.spark.range(0, len(places), 1, len(places)).mapInArrow(fetch, kinds)

    def _places(self) -> list[str]:
        """Conditions that deal all rows, also those that are yet to come, to parts."""
        if self.dialect != "sqlite":
            return [""]
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT (SELECT min(rowid) FROM {self.table}), (SELECT max(rowid) FROM {self.table})")  # apart, neither is a scan
            least, most = cursor.fetchone()
        finally:
            connection.close()
        if least is None:
            return [""]
        step = max(PART, -((least - most - 1) // MOST_PARTS))
        cuts = range(least + step, most + 1, step)
        if not cuts:
            return [""]
        return [f" WHERE rowid < {cuts[0]}", *(f" WHERE rowid >= {x} AND rowid < {x + step}" for x in cuts[:-1]), f" WHERE rowid >= {cuts[-1]}"]

    def chunks(self) -> DataFrame:
        """All chunks; damaged vectors leave theirs out. SQLite's are read by ranges of
        row numbers, each as it is when its turn comes."""
        texts = {"metadata": "metadata::text", "vector": "vector::text"} if self.dialect == "pgvector" else {}
        query = f"SELECT {', '.join(texts.get(c, c) for c in COLUMNS)} FROM {self.table}"
        return store.from_json_rows(self._read(query, COLUMNS, ", ".join(f"{c} string" for c in COLUMNS), self._places()))

    def search(self, vector: Sequence[float], top_k: int, filters: Sequence[MetadataFilter] = ()) -> DataFrame:
        """The nearest chunks: sorted and cut by the database if it knows vectors, else
        by a scan of all rows here."""
        if self.dialect == "pgvector":
            names = ("unit_id", "source_doc_id", "source_uri", "text", "metadata", "score")
            query = store.jdbc_query(self.table, vector, top_k if top_k > 0 else store.DEFAULT_TOP_K, filters)
            return self._read(query, names, ", ".join(f"{c} {'double' if c == 'score' else 'string'}" for c in names))
        return store.search(self.chunks(), vector, top_k, filters)


def _execute(connect: Callable[[], Any], statement: str, batches: Iterator[list[tuple]]) -> None:
    """The batches, some of them in a transaction; the connection closes whatever happens."""
    connection = connect()
    try:
        cursor = connection.cursor()
        for number, batch in enumerate(batches, 1):
            if batch == [()]:
                cursor.execute(statement)
            else:
                cursor.executemany(statement, batch)
            if number % COMMIT == 0:
                connection.commit()
        connection.commit()
    finally:
        connection.close()
