"""Chunkers: a document row becomes chunk rows. Sizes and positions are in bytes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

DEFAULT_SIZE, DEFAULT_MAX, DEFAULT_THRESHOLD = 512, 512, 0.5
#: Separators from the coarsest to the finest; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Columns of a document that its chunks keep.
KEPT = ("source_uri", "tenant_id", "metadata")
SPAN = "struct<start_byte:int,end_byte:int>"


def _sizes(size: int, overlap: int) -> tuple[int, int]:
    size = size if size > 0 else DEFAULT_SIZE
    return size, overlap if 0 <= overlap < size else 0


def _kept(documents: DataFrame) -> list[str]:
    return [c for c in KEPT if c in documents.columns]


def _chunks(documents: DataFrame, spans: Column, context: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Chunk rows from an array of spans of the content's bytes, with what ``context``
    makes of the content and the chunk's text, where it is in the same row."""
    rows = documents.select("document_id", "content", F.col("content").cast("binary").alias("_bytes"), *_kept(documents), F.posexplode(spans).alias("chunk_index", "_span"))
    data = F.substring(F.col("_bytes"), F.col("_span.start_byte") + 1, F.col("_span.end_byte") - F.col("_span.start_byte"))
    return rows.select(
        F.concat(F.col("document_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string")).alias("unit_id"),
        F.col("document_id").cast("string").alias("source_doc_id"),
        *_kept(documents),
        "chunk_index",
        expr.valid_text(data).alias("text"),
        data.alias("data"),
        F.struct(F.col("_span.start_byte"), F.col("_span.end_byte"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("section")).alias("position"),
        F.lit(0).alias("token_count"),
        *([context(F.col("content"), expr.valid_text(data)).alias("context_prefix")] if context else []),
    )


def fixed_spans(content: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` bytes, each ``size - overlap`` after the one before; the
    last one ends with the content."""
    n, step = F.octet_length(content), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start_byte"), F.least(i * step + size, n).alias("end_byte")))
    return F.when(n > 0, windows).otherwise(F.array().cast(f"array<{SPAN}>"))


def fixed(documents: DataFrame, size: int = DEFAULT_SIZE, overlap: int = 0) -> DataFrame:
    """Windows of bytes; they may cut a character in two, whose parts read as U+FFFD."""
    size, overlap = _sizes(size, overlap)
    return _chunks(documents, fixed_spans(F.col("content"), size, overlap))


def sentence_walk(lengths: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of whole sentences of at most ``size`` bytes, or one longer sentence.

    The next run begins ``overlap`` sentences before the end of this one, if that
    is after its own begin.
    """
    ends, out, i = [0, *accumulate(lengths)], [], 0
    while i < len(lengths):
        j = max(i + 1, bisect_right(ends, ends[i] + size) - 1)
        out.append((ends[i], ends[j]))
        i = j - overlap if 0 < overlap < j - i else j
    return out


def _walked(documents: DataFrame, seen: Column, walk: Callable[[object], list[tuple[int, int]]]) -> DataFrame:
    """Chunks of the spans that ``walk`` finds in what it sees of each document."""
    kept = _kept(documents)
    carried = [F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in kept]
    rows = documents.select(F.col("document_id").cast("string"), F.col("content").cast("binary").alias("content"), *carried, seen.alias("_seen"))
    spans = pa.list_(pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start_byte": a, "end_byte": b} for a, b in walk(x)] if x else [] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, spans)], names=[*batch.schema.names[:-1], "_spans"])

    cut = rows.mapInArrow(run, ", ".join(["document_id string", "content binary", *[f"{c} string" for c in kept], f"_spans array<{SPAN}>"]))
    if "metadata" in kept:
        cut = cut.withColumn("metadata", F.parse_json("metadata"))
    return _chunks(cut, F.col("_spans"))


def sentence(documents: DataFrame, size: int = DEFAULT_SIZE, overlap: int = 0) -> DataFrame:
    """Groups of whole sentences; ``overlap`` counts sentences. With an overlap a
    last chunk repeats only what the one before carried over."""
    size, overlap = size if size > 0 else DEFAULT_SIZE, max(0, overlap)
    lengths = F.transform(expr.sentences("content"), lambda s: F.octet_length(s))
    return _walked(documents, lengths, lambda x: sentence_walk(x, size, overlap))


def recursive_spans(data: bytes, size: int, separators: Sequence[bytes]) -> list[tuple[int, int]]:
    """Cuts of ``data`` into pieces of at most ``size`` bytes where separators allow it.

    A work list holds ranges and the separators left for them. A range is cut
    behind each separator; neighbours are joined while they fit, and what is
    still too long is put back with the finer separators.
    """
    done, todo = [], [(0, len(data), 0)]
    while todo:
        low, high, level = todo.pop()
        if high - low <= size or level == len(separators):
            done.append((low, high))
            continue
        mark = separators[level]
        if not mark:
            done += [(i, min(i + size, high)) for i in range(low, high, size)]
            continue
        edges, at = [low], data.find(mark, low, high)
        while at >= 0:
            edges.append(at + len(mark))
            at = data.find(mark, at + len(mark), high)
        if edges[-1] < high:
            edges.append(high)
        if len(edges) <= 2:
            todo.append((low, high, level + 1))
            continue
        joined, begin = [], low
        for before, end in zip(edges[1:-1], edges[2:]):
            if end - begin > size:
                joined.append((begin, before, level + 1))
                begin = before
        joined.append((begin, high, level + 1))
        todo += reversed(joined)
    return done


def recursive(documents: DataFrame, size: int = DEFAULT_SIZE, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Pieces of at most ``size`` bytes, cut at the coarsest separator that makes
    them fit; each but the first begins ``overlap`` bytes earlier."""
    size, overlap = _sizes(size, overlap)
    marks = [s.encode() for s in (separators or SEPARATORS)]

    def walk(data: bytes) -> list[tuple[int, int]]:
        return [(max(a - overlap, 0) if i else a, b) for i, (a, b) in enumerate(recursive_spans(data, size, marks))]

    return _walked(documents, F.col("content").cast("binary"), walk)


def semantic(documents: DataFrame, embed: Callable[[Column], Column], max_size: int = DEFAULT_MAX, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Runs of sentences between drops of similarity.

    A new segment begins where a sentence's cosine to the one before is below
    ``threshold``; neighbouring segments are then joined from the left while they
    fit into ``max_size`` bytes, which never splits one.
    """
    max_size = max_size if max_size > 0 else DEFAULT_MAX
    threshold = threshold if threshold != 0 else DEFAULT_THRESHOLD
    rows = documents.select("document_id", F.posexplode(expr.sentences("content")).alias("at", "said")).withColumn("vector", embed(F.col("said")))
    along = Window.partitionBy("document_id").orderBy("at")
    cut = F.coalesce((expr.cosine(F.lag("vector").over(along), F.col("vector")) < threshold).cast("int"), F.lit(0))
    parts = rows.withColumn("cut", F.when(F.col("at") == 0, 0).otherwise(cut)).withColumn("segment", F.sum("cut").over(along))
    sizes = parts.groupBy("document_id", "segment").agg(F.sum(F.octet_length("said")).cast("int").alias("size"))
    listed = sizes.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "size"))), lambda s: s["size"]).alias("sizes"))
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("out"))
    span = lambda a: F.array(F.struct(a["begin"].alias("start_byte"), a["end"].alias("end_byte")))

    def join(a: Column, size: Column) -> Column:
        end = a["end"] + size
        fits = (a["end"] == a["begin"]) | (end - a["begin"] <= max_size)
        return F.when(fits, F.struct(a["begin"].alias("begin"), end.alias("end"), a["out"].alias("out"))).otherwise(
            F.struct(a["end"].alias("begin"), end.alias("end"), F.concat(a["out"], span(a)).alias("out"))
        )

    spans = listed.select("document_id", F.aggregate("sizes", start, join, lambda a: F.concat(a["out"], span(a))).alias("_spans"))
    return _chunks(documents.join(spans, "document_id"), F.col("_spans"))


def late(documents: DataFrame, embed: Callable[[Column], Column], size: int = DEFAULT_SIZE, overlap: int = 0) -> DataFrame:
    """Fixed windows with a vector each, marked ``late_chunking`` in their metadata."""
    chunks = fixed(documents, size, overlap)
    held = F.col("metadata") if "metadata" in chunks.columns else F.lit(None).cast("variant")
    return chunks.withColumn("metadata", expr.with_key(held, "late_chunking", "true")).withColumn("vector", embed(F.col("text")))


def contextual(documents: DataFrame, context: Callable[[Column, Column], Column], size: int = DEFAULT_SIZE, overlap: int = 0) -> DataFrame:
    """Fixed windows with a prefix made from the document and the chunk."""
    size, overlap = _sizes(size, overlap)
    return _chunks(documents, fixed_spans(F.col("content"), size, overlap), context)


def proposition(documents: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """A chunk for each statement that ``extract`` finds; all span the whole document."""
    kept = _kept(documents)
    rows = documents.select("document_id", *kept, F.octet_length("content").alias("_size"), F.posexplode(extract(F.col("content"))).alias("chunk_index", "text"))
    return rows.select(
        F.concat(F.col("document_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string")).alias("unit_id"),
        F.col("document_id").cast("string").alias("source_doc_id"),
        *kept,
        "chunk_index",
        "text",
        F.struct(F.lit(0).alias("start_byte"), F.col("_size").alias("end_byte"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("section")).alias("position"),
        F.lit(0).alias("token_count"),
    )


def with_parents(documents: DataFrame, child_size: int, parent_size: int) -> tuple[DataFrame, DataFrame]:
    """Small chunks that name the large chunk they begin in, and the large chunks."""
    parents = fixed(documents, parent_size).withColumn("unit_id", F.concat(F.lit("parent-"), F.col("unit_id")))
    size = parent_size if parent_size > 0 else DEFAULT_SIZE
    inside = F.floor(F.col("position.start_byte") / size).cast("string")
    children = fixed(documents, child_size).withColumn("parent_id", F.concat(F.lit("parent-"), F.col("source_doc_id"), F.lit("-"), inside))
    return children, parents
