"""Runs of equal keys in sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str, arrow: pa.Schema) -> DataFrame:
    """Call ``fn`` once for the rows of each key, as columns of Python values.

    Rows are hash-partitioned and sorted by ``keys`` and then streamed, so only
    one group is held at a time; the caller bounds the size of a group.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        out: dict[str, list] = {f.name: [] for f in arrow}
        at = None

        def close() -> None:
            if at is not None and (got := fn(held)):
                for c in out:
                    out[c] += got[c]

        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
            marks = list(zip(*(columns[k] for k in keys)))
            start = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                if marks[start] != at:
                    close()
                    at, held = marks[start], {c: [] for c in names}
                for c in names:
                    held[c] += columns[c][start:i]
                start = i
            if len(out[arrow[0].name]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                out = {f.name: [] for f in arrow}
        close()
        if out[arrow[0].name]:
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
