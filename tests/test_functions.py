from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import expr, schema, serde
from corvane.functions.expr import MetadataFilter
from corvane.operators import retrieve


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "int", float: "double", list: "array<float>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values[n] for n in names)] if names else [(1,)], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0], [1.0, 2.0], 0), ([], [], 0), ([0.0, 0.0], [1.0, 1.0], 0), ([1.0, 0.0], [1.0, 1.0], 0.70710678)],
)
def test_cosine(spark, a, b, want):
    assert one(spark, expr.cosine("a", "b"), a=a, b=b) == pytest.approx(want, abs=1e-7)


def test_tokens(spark):
    assert one(spark, expr.tokens("t"), t="The  CAT\tsat\n") == ["the", "cat", "sat"]
    assert one(spark, expr.marked_tokens("t"), t="Hello, world!") == ["hello", ",", "world", "!"]
    assert len(one(spark, expr.marked_tokens("t"), t="it's a test-case (really)")) == 10
    assert one(spark, expr.token_count("t"), t="") == 0
    assert one(spark, expr.approximate_count("t"), t="éé12345") == 2


@pytest.mark.parametrize(("text", "want"), [("0.85", 0.85), ("Score: 0.7", 0.7), ("The score is 0.95 out of 1.0", 0.95), ("no numbers here", 0), ("1", 1), ("85%", 85), ("-0.5", 0.5), (".5", 5)])
def test_parse_score(spark, text, want):
    assert one(spark, expr.parse_score("t"), t=text) == want


def test_sentences(spark):
    assert one(spark, expr.sentences("t"), t="Hello! World? Yes.\nNo. ") == ["Hello! ", "World? ", "Yes.\n", "No. "]


def test_texts_of_units(spark):
    df = spark.createDataFrame([("t", None, None), ("t", "", "p"), ("t", "w", "p")], "text string, window_text string, context_prefix string")
    assert [r.x for r in df.select(expr.as_text().alias("x")).collect()] == ["t", "p t", "w"]
    assert one(spark, expr.fact_text("s", "p", "o"), s="Go", p="is", o="fast") == "Go is related to fast via is."
    rows = spark.sql("SELECT map('b', '2', 'a', '1', 'c', cast(NULL AS string)) AS m")
    assert rows.select(expr.row_text("m").alias("x")).first().x == "[row] a: 1, b: 2, c: <nil>"


def test_scores(spark):
    df = spark.range(1).select(expr.with_score(expr.with_score(F.lit(None).cast(expr.SCORES), "a", F.lit(0.5)), "b", F.lit(2)).alias("s"))
    row = df.select("s", expr.last_score("s").alias("last"), expr.last_score(F.array().cast(expr.SCORES)).alias("none")).first()
    assert [(e.stage, e.score) for e in row.s] == [("a", 0.5), ("b", 2.0)] and row.last == 2.0 and row.none == 0.0


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (MetadataFilter("tenant", "eq", "acme"), True), (MetadataFilter("tenant", "eq", "other"), False), (MetadataFilter("count", "eq", 42), True), (MetadataFilter("count", "eq", "42"), True),
        (MetadataFilter("flag", "eq", True), True), (MetadataFilter("status", "in", ["active", "pending"]), True), (MetadataFilter("status", "in", ["archived"]), False), (MetadataFilter("status", "in", "active"), False),
        (MetadataFilter("tags", "any_of", ["go", "java"]), True), (MetadataFilter("tags", "any_of", ["java", "c++"]), False), (MetadataFilter("status", "any_of", ["active"]), False), (MetadataFilter("absent", "eq", "x"), False),
        (MetadataFilter("tenant", "like", "acme"), False),
    ],
)
def test_metadata_filters(spark, f, want):
    df = spark.sql("""SELECT parse_json('{"tenant":"acme","count":42,"flag":true,"status":"active","tags":["go","rust"]}') AS metadata""")
    assert df.select(f.column().alias("x")).first().x is want
    assert spark.sql("SELECT cast(NULL AS variant) AS metadata").select(f.column().alias("x")).first().x is False


def test_all_filters_and_pushdown(spark, tmp_path):
    df = spark.sql("""SELECT parse_json('{"a":"1"}') AS metadata, 'x' AS lang""")
    assert df.where(expr.match_all([])).count() == 1
    assert df.where(expr.match_all([MetadataFilter("a", "eq", 1), MetadataFilter("lang", "eq", "y")], df.columns)).count() == 0
    df.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(MetadataFilter("lang", "eq", "x").column(["lang"]))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,x)" in plan or "lang" in plan.split("PushedFilters")[1]


def test_with_key(spark):
    df = spark.sql("""SELECT parse_json('{"a":1,"late":false}') AS m UNION ALL SELECT NULL""")
    got = [r.x for r in df.select(F.to_json(expr.with_key("m", "late", "true")).alias("x")).collect()]
    assert got == ['{"a":1,"late":true}', '{"late":true}']


def test_vectors_as_text(spark):
    df = spark.createDataFrame([([1.0, 2.5, 3.0],), (None,)], "v array<float>")
    assert [r.x for r in df.select(expr.vector_literal("v").alias("x")).collect()] == ["[1.0,2.5,3.0]", "[]"]
    assert one(spark, expr.vector_from("t"), t="[1,2.5,3]") == [1.0, 2.5, 3.0]
    assert one(spark, expr.vector_from("t"), t="nonsense") is None


def test_fingerprint_and_wildcards(spark):
    assert len(one(spark, expr.fingerprint("t"), t="x")) == 32
    assert one(spark, expr.matches_wildcard("p", "v"), p="*", v="x") and one(spark, expr.matches_wildcard("p", "v"), p="x", v="x")
    assert not one(spark, expr.matches_wildcard("p", "v"), p="x*", v="xy")


def test_envelopes(spark):
    chunk = spark.sql("""SELECT 'c' AS unit_id, 'd' AS source_doc_id, '' AS source_uri, 't' AS text, array(1f, 2f) AS vector, array(named_struct('stage','bm25','score',0.5D)) AS scores,
        named_struct('start_byte',0,'end_byte',3,'page',cast(NULL AS int),'section',array('s')) AS position, 0 AS token_count, 'p' AS parent_id, parse_json('{"k":1}') AS metadata""")
    wrapped = chunk.select(serde.wrap(serde.CHUNK, chunk.columns).alias("e"))
    data = wrapped.first().e.data
    assert '"source_uri"' not in data and '"token_count"' not in data and '"text":"t"' in data
    u = wrapped.select(serde.unwrap(F.col("e"), serde.CHUNK).alias("u")).first().u
    assert (u.id, u.source_doc_id, u.text, u.vector, u.scores[0].score, u.position.section, u.parent_id) == ("c", "d", "t", [1.0, 2.0], 0.5, ["s"], "p")
    row = spark.sql("SELECT 'r' AS unit_id, 'd' AS source_doc_id, map('a','1') AS columns")
    again = row.select(serde.wrap(serde.ROW, row.columns).alias("e")).select(serde.unwrap(F.col("e"), serde.ROW).alias("u"), serde.unwrap(F.col("e"), serde.FACT).alias("f")).first()
    assert again.u.columns == {"a": "1"} and again.f is None
    with pytest.raises(ValueError):
        serde.wrap("poem", [])
    with pytest.raises(Exception, match="unknown unit type"):
        spark.sql("SELECT named_struct('type','poem','data','{}') AS e").select(serde.unwrap(F.col("e"), serde.CHUNK)).collect()


def test_wanted(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (3,)], "top_k int")
    assert [r.k for r in df.select(retrieve.wanted().alias("k")).collect()] == [10, 10, 10, 3]


def test_rows_of_schemas(spark):
    chunk = schema.chunk_rows(spark, [{"unit_id": "c", "text": "t", "vector": [1.0], "metadata": {"k": [1]}}, {"unit_id": "d"}]).withColumn("m", F.to_json("metadata")).orderBy("unit_id").collect()
    assert [(r.unit_id, r.text, r.vector, r.m) for r in chunk] == [("c", "t", [1.0], '{"k":[1]}'), ("d", None, None, None)]
    assert schema.fact_rows(spark, [{"unit_id": "f", "subject": "s", "predicate": "p", "object": "o"}]).select(expr.fact_text().alias("x")).first().x == "s is related to o via p."
    assert schema.query_rows(spark, [{"query_id": "q", "text": "t"}]).columns == ["query_id", "text", "tenant_id", "subject", "top_k"]
