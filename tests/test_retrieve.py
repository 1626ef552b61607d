from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.expr import SCORES, MetadataFilter
from corvane.operators import rerank, retrieve
from corvane.operators.retrieve import Bm25Index, Route, bm25, ensemble, graph, hybrid, router, small_to_big, structured, vector, web

CATS = [("1", "the cat sat on the mat"), ("2", "the dog ran in the park"), ("3", "a quick brown fox jumps over the lazy dog")]


def chunks(spark, rows, metadata=None):
    df = spark.createDataFrame([(i, f"d{i}", t) for i, t in rows], "unit_id string, source_doc_id string, text string")
    return df if metadata is None else df.withColumn("metadata", F.parse_json(F.element_at(F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]), F.col("unit_id"))))


def asked(spark, *texts, k=3):
    return spark.createDataFrame([(f"q{i}", t, k) for i, t in enumerate(texts)], "query_id string, text string, top_k int")


def ids(df):
    return [r.unit_id for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_scores(spark):
    index = Bm25Index.build(chunks(spark, CATS))
    rows = bm25(index, asked(spark, "cat mat")).collect()
    term = math.log(1 + 2.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / 7))
    assert [r.unit_id for r in rows] == ["1"] and rows[0].score == pytest.approx(2 * term) and [s.stage for s in rows[0].scores] == ["bm25"]
    once, twice = (bm25(index, asked(spark, t)).first().score for t in ("cat", "cat cat"))
    assert twice == pytest.approx(2 * once)
    assert ids(bm25(index, asked(spark, "zebra"))) == [] and ids(bm25(index, asked(spark, ""))) == []


def test_bm25_limits_and_ties(spark):
    index = Bm25Index.build(chunks(spark, [("c", "apple pie"), ("a", "apple tart"), ("b", "apple cake")]))
    assert ids(bm25(index, asked(spark, "apple", k=2))) == ["a", "b"]
    many = Bm25Index.build(chunks(spark, [(f"{i:02}", "apple") for i in range(20)]))
    assert len(ids(bm25(many, asked(spark, "apple", k=0)))) == 10


def test_bm25_filters_keep_statistics(spark):
    index = Bm25Index.build(chunks(spark, [("c1", "deep learning a"), ("c2", "deep learning b"), ("c3", "deep learning c")], {"c1": '{"t":"acme"}', "c2": '{"t":"acme"}', "c3": '{"t":"globex"}'}))
    free = {r.unit_id: r.score for r in bm25(index, asked(spark, "deep learning")).collect()}
    bound = {r.unit_id: r.score for r in bm25(index, asked(spark, "deep learning"), [MetadataFilter("t", "eq", "acme")]).collect()}
    assert set(free) == {"c1", "c2", "c3"} and bound == {k: free[k] for k in ("c1", "c2")}


def test_bm25_tenants_and_stored_index(spark, tmp_path):
    rows = chunks(spark, [("c1", "deep"), ("c2", "deep")]).withColumn("tenant_id", F.when(F.col("unit_id") == "c1", "acme").otherwise("globex"))
    index = Bm25Index.build(rows).write(str(tmp_path))
    queries = asked(spark, "deep", "deep").withColumn("tenant_id", F.when(F.col("query_id") == "q0", "acme"))
    assert ids(bm25(index, queries)) == ["c1", "c1", "c2"]


VECTORS = [("far", [0.0, 1.0, 0.0]), ("close", [0.95, 0.05, 0.0]), ("exact", [1.0, 0.0, 0.0]), ("none", None), ("short", [1.0])]


def vector_rows(spark):
    return spark.createDataFrame([(i, i, i, v) for i, v in VECTORS], "unit_id string, source_doc_id string, text string, vector array<float>")


def test_vector_search(spark):
    queries = asked(spark, "x", k=5).withColumn("vector", F.expr("array(1f, 0f, 0f)"))
    rows = vector(vector_rows(spark), queries).orderBy("rank").collect()
    assert [r.unit_id for r in rows] == ["exact", "close", "far", "short"] and rows[0].score == pytest.approx(1) and rows[3].score == 0
    labelled = vector_rows(spark).withColumn("tenant", F.when(F.col("unit_id") != "exact", "a")).withColumn("kind", F.when(F.col("unit_id") != "far", "k"))
    both = vector(labelled, queries, filters=[MetadataFilter("tenant", "eq", "a"), MetadataFilter("kind", "eq", "k")])
    assert ids(both) == ["close", "short"]


def test_blocks_of_queries(spark, monkeypatch):
    queries = asked(spark, *"abcdefgh", k=2).withColumn("vector", F.expr("array(1f, 0f, 0f)"))
    whole = sorted(map(str, vector(vector_rows(spark), queries).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    assert sorted(map(str, vector(vector_rows(spark), queries).collect())) == whole


def ranked(spark, rows):
    df = spark.createDataFrame([("q0", i + 1, u, s) for i, (u, s) in enumerate(rows)], "query_id string, rank int, unit_id string, score double")
    return retrieve.units(df.withColumn("as_text", F.col("unit_id")).withColumn("scores", F.array(F.struct(F.lit("test").alias("stage"), F.col("score").alias("score"))).cast(SCORES)))


def test_hybrid(spark):
    a, b = ranked(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), ranked(spark, [("b", 0.95), ("c", 0.85), ("d", 0.75)])
    rows = hybrid(asked(spark, "x", k=10), [a, b]).orderBy("rank").collect()
    want = {"b": 1 / 62 + 1 / 61, "c": 1 / 63 + 1 / 62, "a": 1 / 61, "d": 1 / 63}
    assert [r.unit_id for r in rows] == ["b", "c", "a", "d"] and all(r.score == pytest.approx(want[r.unit_id], abs=1e-9) for r in rows)
    assert [s.score for s in rows[0].scores] == [0.8, pytest.approx(want["b"])] and rows[0].scores[-1].stage == "rrf_fusion"
    same = hybrid(asked(spark, "x"), [ranked(spark, [("s", 1.0)])] * 2, k=-1).first()
    assert same.score == pytest.approx(2 / 61)


def test_ensemble(spark):
    rows = ensemble(asked(spark, "x"), [ranked(spark, [("c1", 0.5)]), ranked(spark, [("c1", 0.9), ("c2", 0.8)])]).orderBy("rank").collect()
    assert [(r.unit_id, r.score) for r in rows] == [("c2", 0.8), ("c1", 0.5)]
    assert ids(ensemble(asked(spark, "x"), [ranked(spark, [("c1", 0.9), ("c2", 0.8)]), ranked(spark, [("c3", 0.7)])])) == ["c1", "c2", "c3"]


def test_router(spark):
    index = Bm25Index.build(chunks(spark, CATS))
    routes = [Route("dogs", lambda q: bm25(index, q), lambda t: F.contains(t, F.lit("dog"))), Route("never", lambda q: bm25(index, q), lambda t: F.lit(False))]
    rows = router(asked(spark, "lazy dog", "cat"), routes).collect()
    assert {r.query_id for r in rows} == {"q0"}


def test_graph(spark):
    facts = spark.createDataFrame([("f1", "d", "Go", "is", "programming language"), ("f2", "d", "Python", "is", "programming language"), ("f3", "d", "Go", "has", "goroutines")], "unit_id string, source_doc_id string, subject string, predicate string, object string")
    rows = graph(facts, asked(spark, "Go programming", "Rust", "")).orderBy("rank").collect()
    assert [(r.unit_id, r.score) for r in rows] == [("f1", 1.0), ("f2", 0.5), ("f3", 0.5)] and rows[0].as_text == "Go is related to programming language via is." and rows[0].unit_type == "graph_fact"


def test_small_to_big(spark):
    found = ranked(spark, [("child-1", 0.9), ("child-2", 0.85), ("child-3", 0.95), ("orphan", 0.5), ("orphan", 0.4)]).withColumn("parent_id", F.expr("CASE unit_id WHEN 'child-2' THEN 'p2' WHEN 'orphan' THEN 'gone' ELSE 'p1' END"))
    parents = spark.createDataFrame([("p1", "d1", "one"), ("p2", "d2", "two")], "unit_id string, source_doc_id string, text string")
    rows = small_to_big(found, parents).orderBy("rank").collect()
    assert [(r.rank, r.unit_id, r.score, r.as_text) for r in rows] == [(1, "p1", 0.95, "one"), (2, "p2", 0.85, "two"), (3, "orphan", 0.5, "orphan"), (4, "orphan", 0.4, "orphan")]
    assert [s.stage for s in rows[0].scores] == ["small_to_big"] and [s.stage for s in rows[2].scores] == ["test"]


def test_structured_and_web(spark):
    rows = structured(spark, "q0", "who", lambda t: "SELECT * FROM VALUES ('Alice', 35), ('Bob', 42) AS t(name, age) WHERE age > :least ORDER BY age", "users-db", {"least": 30}).orderBy("rank").collect()
    assert [(r.unit_id, r.as_text, r.score, r.source_doc_id) for r in rows] == [("row-0", "[row] age: 35, name: Alice", 1.0, "users-db"), ("row-1", "[row] age: 42, name: Bob", 1.0, "users-db")]
    found = web(asked(spark, "go", k=0), lambda text, k: [(f"http://{text}/{i}", "title", "snippet") for i in range(k)]).orderBy("rank").collect()
    assert len(found) == 10 and found[1].unit_id == found[1].source_uri == "http://go/1" and found[1].score == pytest.approx(0.99) and found[0].source_doc_id == "web"


def test_cross_encoder(spark):
    found = ranked(spark, [("alpha", 0.1), ("beta", 0.2), ("gamma", 0.3), ("delta", 0.4)])
    score = lambda q, t: F.element_at(F.create_map(*[F.lit(x) for x in ("alpha", 0.3, "beta", 0.9, "gamma", 0.6, "delta", -0.2)]), t)
    rows = rerank.cross_encoder(found, asked(spark, "q"), score).orderBy("rank").collect()
    assert [r.unit_id for r in rows] == ["beta", "gamma", "alpha"] and [s.stage for s in rows[0].scores] == ["test", "crossencoder"]
    assert ids(rerank.cross_encoder(found, asked(spark, "q"), score, top_k=2)) == ["beta", "gamma"]
    assert ids(rerank.cross_encoder(found, asked(spark, "q"), score, threshold=0.4)) == ["beta", "gamma"]
    assert ids(rerank.cross_encoder(found, asked(spark, "q"), score, threshold=None))[-1] == "delta"


@pytest.mark.parametrize(("n", "want"), [(1, [0]), (2, [0, 1]), (4, [0, 2, 3, 1]), (5, [0, 2, 4, 3, 1])])
def test_lost_in_the_middle(spark, n, want):
    rows = rerank.lost_in_the_middle(ranked(spark, [(str(i), 1 - i / 10) for i in range(n)])).orderBy("rank").collect()
    assert [int(r.unit_id) for r in rows] == want and [r.rank for r in rows] == list(range(1, n + 1))
    assert all(r.scores[-1].stage == "litm_reorder" and r.scores[-1].score == r.scores[-2].score for r in rows)


def test_graph_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abÉ") for _ in range(rng.randrange(1, 5)))
    facts = [(f"f{i}", " ".join(word() for _ in range(3)), word(), word()) for i in range(60)]
    asked = [(f"q{i}", " ".join(word() for _ in range(rng.randrange(4))), 100) for i in range(20)]
    got = retrieve.graph(spark.createDataFrame(facts, "unit_id string, subject string, predicate string, object string"), spark.createDataFrame(asked, "query_id string, text string, top_k int")).collect()
    want = {}
    for q, text, _ in asked:
        for f, *said in facts:
            terms = text.lower().split()
            hits = sum(t in " ".join(said).lower() for t in terms)
            if hits:
                want[q, f] = hits / len(terms)
    assert {(r.query_id, r.unit_id): pytest.approx(r.score) for r in got} == want


def test_rows_of_many_partitions_keep_their_order(spark):
    spark.range(0, 1000, 1, 7).createOrReplaceTempView("many")
    got = retrieve.structured(spark, "q", "all", lambda t: "SELECT id FROM many ORDER BY id DESC", "db").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001)) and [r.unit_id for r in got[:2]] == ["row-0", "row-1"] and got[0].as_text == "[row] id: 999"


def test_many_words_of_queries_are_joined_by_shuffles(spark, monkeypatch):
    docs = spark.createDataFrame([(f"c{i}", " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "unit_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 3} w{i}", 5) for i in range(12)], "query_id string, text string, top_k int")
    told = lambda: sorted((r.query_id, r.rank, r.unit_id, r.score) for r in bm25(Bm25Index.build(docs), asked, digits=6).collect())
    one = told()
    monkeypatch.setattr(retrieve, "ASKED_ROWS", 0)
    assert one and told() == one
