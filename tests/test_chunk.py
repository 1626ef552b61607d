from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, embed

DATA = "/root/testdata/sf0.001"


def docs(spark, *texts):
    rows = [(f"doc-{i}" if len(texts) > 1 else "doc", t, "uri") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, content string, source_uri string").withColumn("metadata", F.parse_json(F.lit('{"a":1}')))


def spans(df):
    return [(r.text, r.position.start_byte, r.position.end_byte) for r in df.orderBy("source_doc_id", "chunk_index").collect()]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("hello world", 100, 0, ["hello world"]), ("abcdefghij", 5, 0, ["abcde", "fghij"]), ("abcdefg", 4, 0, ["abcd", "efg"]), ("abcdefghijkl", 6, 2, ["abcdef", "efghij", "ijkl"]), ("", 10, 0, []),
        ("a" * 1024, 0, 0, ["a" * 512] * 2), ("abcdefghij", 5, 5, ["abcde", "fghij"]), ("abc", 1, 0, ["a", "b", "c"]),
    ],
)
def test_fixed(spark, text, size, overlap, want):
    got = spans(chunk.fixed(docs(spark, text), size, overlap))
    assert [t for t, _, _ in got] == want and all(text[a:b] == t for t, a, b in got)


def test_fixed_ids_and_metadata(spark):
    rows = chunk.fixed(docs(spark, "abcdefghi"), 3).orderBy("unit_id").select("unit_id", "source_doc_id", "source_uri", F.to_json("metadata").alias("m"), "token_count").collect()
    assert [tuple(r) for r in rows] == [(f"doc-{i}", "doc", "uri", '{"a":1}', 0) for i in range(3)]


def test_cut_inside_a_character(spark):
    rows = chunk.fixed(docs(spark, "añb"), 2).orderBy("chunk_index").collect()
    assert [bytes(r.data).hex() for r in rows] == ["61c3", "b162"] and [r.text for r in rows] == ["a�", "�b"]


@pytest.mark.parametrize(
    ("text", "size", "separators", "want"),
    [
        ("Hello world.\n\nSecond paragraph.", 20, (), ["Hello world.\n\n", "Second paragraph."]), ("abcdefghij", 5, (), ["abcde", "fghij"]), ("abc;defgh;ij", 8, (";", ""), ["abc;", "defgh;ij"]), ("", 5, (), []),
        ("First paragraph.\n\nSecond paragraph.\n\nThird paragraph.", 30, (), ["First paragraph.\n\n", "Second paragraph.\n\n", "Third paragraph."]), ("abcdefghij", 5, (" ",), ["abcdefghij"]),
        ("line one\nline two\nline three", 15, (), ["line one\n", "line two\n", "line three"]), ("one two three four", 10, (), ["one two ", "three four"]),
    ],
)
def test_recursive(spark, text, size, separators, want):
    got = spans(chunk.recursive(docs(spark, text), size, 0, separators))
    assert [t for t, _, _ in got] == want


def test_recursive_overlap(spark):
    got = spans(chunk.recursive(docs(spark, "Hello world.\n\nSecond paragraph."), 20, 5))
    assert got[1][1:] == (9, 31)


def plain_recursive(text: str, size: int, marks: list[str]) -> list[str]:
    """The definition, as a recursion over strings."""
    if len(text) <= size or not marks:
        return [text]
    if not marks[0]:
        return [text[i : i + size] for i in range(0, len(text), size)]
    pieces = [p + marks[0] for p in text.split(marks[0])]
    pieces[-1] = pieces[-1][: -len(marks[0])]
    pieces = [p for p in pieces if p]
    if marks[0] not in text:
        return plain_recursive(text, size, marks[1:])
    if len(pieces) == 1:
        return plain_recursive(text, size, marks[1:])
    out, held = [], ""
    for p in pieces:
        if held and len(held) + len(p) > size:
            out += plain_recursive(held, size, marks[1:])
            held = ""
        held += p
    return out + (plain_recursive(held, size, marks[1:]) if held else [])


def test_recursive_against_the_definition():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "bc", " ", ". ", "\n", "\n\n", "x" * 9]) for _ in range(rng.randrange(60)))
        size = rng.randrange(1, 30)
        if text:
            cuts = chunk.recursive_spans(text.encode(), size, [s.encode() for s in chunk.SEPARATORS])
            assert [text[a:b] for a, b in cuts] == plain_recursive(text, size, list(chunk.SEPARATORS)), (text, size)


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("Hello world.", 100, 0, ["Hello world."]), ("First. Second. Third. Fourth.", 20, 0, ["First. Second. ", "Third. Fourth."]), ("AAA. BBB. CCC. DDD.", 25, 1, ["AAA. BBB. CCC. DDD.", "DDD."]), ("", 9, 0, []),
        ("This is a very long sentence without ending", 5, 0, ["This is a very long sentence without ending"]), ("First sentence.\nSecond sentence.\nThird.", 30, 0, ["First sentence.\n", "Second sentence.\nThird."]), ("Hello! World? Yes.", 8, 0, ["Hello! ", "World? ", "Yes."]),
    ],
)
def test_sentence(spark, text, size, overlap, want):
    got = spans(chunk.sentence(docs(spark, text), size, overlap))
    assert [t for t, _, _ in got] == want and all(text[a:b] == t for t, a, b in got)


def vectors(table):
    return lambda c: F.coalesce(*[F.when(c == k, F.array(*[F.lit(float(x)) for x in v])) for k, v in table.items()])


@pytest.mark.parametrize(
    ("text", "table", "size", "want"),
    [
        ("The cat sat. The cat slept. The stock rose. ", {"The cat sat. ": (1, 0, 0), "The cat slept. ": (1, 0, 0), "The stock rose. ": (0, 1, 0)}, 30, ["The cat sat. The cat slept. ", "The stock rose. "]),
        ("A is good. B is good. C is good. ", {f"{c} is good. ": (1, 1, 0) for c in "ABC"}, 1000, ["A is good. B is good. C is good. "]),
        ("A. B. C. D. ", {"A. ": (1, 0, 0), "B. ": (0, 1, 0), "C. ": (0, 1, 0), "D. ": (0, 0, 1)}, 1000, ["A. B. C. D. "]),
        ("Hello world. Goodbye world. ", {"Hello world. ": (1, 0), "Goodbye world. ": (0, 1)}, 10, ["Hello world. ", "Goodbye world. "]),
    ],
)
def test_semantic(spark, text, table, size, want):
    got = spans(chunk.semantic(docs(spark, text), vectors(table), size, 0.5))
    assert [t for t, _, _ in got] == want and got[0][1] == 0


def test_late_contextual_proposition(spark):
    rows = chunk.late(docs(spark, "abcdefghij"), embed.letter_frequency, 5).orderBy("unit_id").select(F.to_json("metadata").alias("m"), "vector").collect()
    assert [r.m for r in rows] == ['{"a":1,"late_chunking":true}'] * 2 and rows[0].vector[:6] == [1, 1, 1, 1, 1, 0]
    rows = chunk.contextual(docs(spark, "abcdef"), lambda d, c: F.concat(F.lit("About: "), F.substring(d, 1, 3)), 3).orderBy("unit_id").collect()
    assert [r.context_prefix for r in rows] == ["About: abc"] * 2
    rows = chunk.proposition(docs(spark, "one two three"), lambda c: F.split(c, " ")).orderBy("unit_id").collect()
    assert [(r.unit_id, r.text, r.position.start_byte, r.position.end_byte) for r in rows] == [("doc-0", "one", 0, 13), ("doc-1", "two", 0, 13), ("doc-2", "three", 0, 13)]


def test_lossless_on_real_documents(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("cast(doc_id AS string) AS document_id", "text AS content")
    whole = {r.document_id: r.content.encode() for r in real.collect()}
    for chunks, bound in ((chunk.fixed(real, 300), 300), (chunk.recursive(real, 300), 300), (chunk.sentence(real, 300), None), (chunk.semantic(real, embed.letter_frequency, 400, 0.8), None)):
        parts = {}
        for r in chunks.orderBy("source_doc_id", "chunk_index").collect():
            data = bytes(r.data)
            assert data == whole[r.source_doc_id][r.position.start_byte : r.position.end_byte] and (bound is None or len(data) <= bound)
            parts.setdefault(r.source_doc_id, []).append(data)
        assert {k: b"".join(v) for k, v in parts.items()} == whole


def test_parents(spark):
    children, parents = chunk.with_parents(docs(spark, "abcdefghij"), 3, 6)
    assert [(r.text, r.parent_id) for r in children.orderBy("chunk_index").collect()] == [("abc", "parent-doc-0"), ("def", "parent-doc-0"), ("ghi", "parent-doc-1"), ("j", "parent-doc-1")]
    assert [r.unit_id for r in parents.orderBy("chunk_index").collect()] == ["parent-doc-0", "parent-doc-1"]


def test_embedders(spark):
    calls = embed.by_function(lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "unit_id string, text string")
    rows = embed.embed_chunks(df, calls).orderBy("unit_id").collect()
    assert [r.vector for r in rows] == [[2.0, 1.0], [3.0, 1.0]] and rows[0].norm == pytest.approx(5**0.5)
    hashed = df.select(embed.feature_hashing(8)(F.lit("a b a")).alias("v")).first().v
    assert sum(hashed) == 3 and len(hashed) == 8
    held = df.withColumn("vector", F.when(F.col("unit_id") == "a", F.array(F.lit(9.0)).cast("array<float>")))
    assert [r.vector for r in embed.embed_chunks(held, calls).orderBy("unit_id").collect()] == [[9.0], [3.0, 1.0]]


def test_many_sentences_take_linear_time():
    lengths = [7] * 400_000
    spans = chunk.sentence_walk(lengths, 512, 2)
    assert spans[0] == (0, 511) and spans[1][0] == 511 - 14 and spans[-1][1] == 7 * 400_000
