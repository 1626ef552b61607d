from __future__ import annotations

import contextlib
import functools
import json
import os
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corvane.functions.expr import MetadataFilter
from corvane.operators import auth, chunk, embed, evaluate, retrieve
from corvane.operators.auth import Allowlist, Mode, Noop, RoleBased
from corvane.plans import session
from corvane.plans.pipeline import Hook, Pipeline, log_hook
from corvane.sources import database, documents, http, store
from corvane.streaming import ingest


def pairs(spark, rows, names="subject string, resource string"):
    return spark.createDataFrame(rows, names)


def test_allowlist(spark):
    a = Allowlist(pairs(spark, [("alice", "doc-1"), ("alice", "doc-2"), ("bob", "doc-2"), ("bob", "doc-3")]))
    assert auth.check(a, spark, "alice", "read", "doc-1") and not auth.check(a, spark, "charlie", "read", "doc-1")
    more = a.grant(pairs(spark, [("charlie", "doc-1")]))
    assert auth.check(more, spark, "charlie", "write", "doc-1")
    assert not auth.check(more.revoke(pairs(spark, [("charlie", "doc-1")])), spark, "charlie", "read", "doc-1")
    assert sorted(r.resource for r in a.resources(pairs(spark, [("alice",)], "subject string"), "read").collect()) == ["doc-1", "doc-2"]
    assert Noop().resources(None, "read") is None and auth.check(Noop(), spark, "x", "y", "z")


def test_roles(spark):
    policies = pairs(spark, [("admin", "*", "*"), ("reader", "*", "read"), ("*", "doc-9", "read")], "subject string, resource string, action string")
    r = RoleBased(policies, pairs(spark, [("alice", "admin"), ("bob", "reader")], "subject string, role string"))
    got = [auth.check(r, spark, s, a, d) for s, a, d in (("alice", "write", "doc-1"), ("bob", "read", "doc-1"), ("bob", "write", "doc-1"), ("eve", "read", "doc-9"), ("eve", "read", "doc-1"), ("admin", "read", "x"))]
    assert got == [True, True, False, True, False, True]


def found(spark, ids):
    df = spark.createDataFrame([("q", i + 1, d, d, 1.0 - i / 10) for i, d in enumerate(ids)], "query_id string, rank int, unit_id string, source_doc_id string, score double")
    return retrieve.units(df.withColumn("as_text", F.col("unit_id")))


def test_post_filter_keeps_order(spark):
    a = Allowlist(pairs(spark, [("u", "doc1"), ("u", "doc3")]))
    queries = spark.createDataFrame([("q", "t", 3, "u"), ("r", "t", 3, None)], "query_id string, text string, top_k int, subject string")
    rows = auth.post_filter(found(spark, ["doc1", "doc2", "doc3"]), queries, a).orderBy("rank").collect()
    assert [(r.rank, r.unit_id) for r in rows] == [(1, "doc1"), (3, "doc3")]


def test_evaluation(spark):
    cases = spark.createDataFrame([("q", "?", None, ["doc-a", "doc-c"]), ("none", "?", None, ["doc-a"]), ("open", "?", None, None), ("twice", "?", None, ["doc-a", "doc-a", "x"])], "case_id string, question string, reference_answer string, relevant_document_ids array<string>")
    hits = found(spark, ["doc-a", "doc-b", "doc-c", "doc-d"])
    hits = hits.unionByName(hits.withColumn("query_id", F.lit("twice"))).unionByName(hits.withColumn("query_id", F.lit("open")))
    rows = {r.case_id: r for r in evaluate.evaluate(cases, lambda q: hits, generate=lambda q, c: F.substring(c, 1, 5), judge=lambda p: F.lit("Score: 0.7")).collect()}
    assert (rows["q"].context_precision, rows["q"].context_recall) == (0.5, 1.0) and rows["q"].context == "doc-a\n\ndoc-b\n\ndoc-c\n\ndoc-d" and rows["q"].answer == "doc-a" and rows["q"].faithfulness == 0.7
    assert (rows["none"].context_precision, rows["none"].context_recall) == (0.0, 0.0) and (rows["open"].context_precision, rows["open"].context_recall) == (None, None)
    assert rows["twice"].context_recall == pytest.approx(2 / 3)
    assert evaluate.evaluate(cases, lambda q: hits).first().faithfulness is None


def test_documents(spark):
    df = spark.createDataFrame([("1", "some plain text", "acme")], "id string, body string, tenant string")
    row = documents.documents_from(df, "id", "body", tenant_id="tenant").first()
    assert (row.mime_type, row.size, row.language, row.tenant_id, len(row.fingerprint)) == ("text/plain", 15, "en", "acme", 32)
    for bad in (("", "x", "t"), ("1", None, "t"), ("1", "x", "")):
        with pytest.raises(Exception, match="must not be"):
            documents.documents_from(spark.createDataFrame([bad], df.schema), "id", "body", tenant_id="tenant").collect()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld")
    text = documents.read_text(spark, str(tmp_path)).first()
    binary = documents.read_binary(spark, str(tmp_path / "a.txt")).first()
    assert text.content == binary.content == "héllo\nworld" and text.size == binary.size == 12 and text.document_id.endswith("a.txt") and binary.mime_type == "application/octet-stream"
    assert documents.read_stream_of_files(spark, str(tmp_path)).count() == 1


def test_upsert_delete_search(spark):
    schema = "unit_id string, source_doc_id string, text string, vector array<float>, seq int"
    old = spark.createDataFrame([("c1", "d", "old", [1.0, 0.0], 0), ("c2", "d", "keep", [0.0, 1.0], 0)], schema)
    new = spark.createDataFrame([("c1", "d", "new", [1.0, 0.0], 1), ("c1", "d", "newer", [1.0, 0.0], 2)], schema)
    got = {r.unit_id: r.text for r in store.upsert(old, new, order="seq").collect()}
    assert got == {"c1": "newer", "c2": "keep"}
    assert [r.unit_id for r in store.delete(old, spark.createDataFrame([("c1",), ("zz",)], "unit_id string")).collect()] == ["c2"]
    assert [r.unit_id for r in store.search(old, [1.0, 0.0], 5).collect()] == ["c1", "c2"] and store.search(old, [1.0, 0.0], 0).collect() == []
    assert [r.unit_id for r in store.search(old, [1.0, 0.0], 5, [MetadataFilter("text", "eq", "keep")]).collect()] == ["c2"]
    assert [r.unit_id for r in store.search(old, [1.0, 0.0], 5, threshold=0.5).collect()] == ["c1"]


def test_store_is_found_again(spark, tmp_path):
    first = store.TableStore(spark, "again", str(tmp_path / "s"))
    first.ensure("unit_id string, source_doc_id string, text string")
    assert first.chunks().count() == 0
    row = lambda i, t: spark.createDataFrame([(i, "d", t)], "unit_id string, source_doc_id string, text string")
    first.store(row("a", "one"))
    second = store.TableStore(spark, "again", str(tmp_path / "s"))
    second.store(row("b", "two"))
    second.store(row("a", "three"))
    assert sorted((r.unit_id, r.text) for r in store.TableStore(spark, "again", str(tmp_path / "s")).chunks().collect()) == [("a", "three"), ("b", "two")]
    second.delete(["a", "zz"])
    second.delete([])
    assert [r.unit_id for r in second.chunks().collect()] == ["b"]


def test_json_rows_and_ddl(spark):
    rows = spark.createDataFrame([("a", "[1,2]", '{"k":1}'), ("b", "oops", "{}"), ("c", "[]", "oops")], "unit_id string, vector string, metadata string")
    got = {r.unit_id: (r.vector, r.m) for r in store.from_json_rows(rows).withColumn("m", F.to_json("metadata")).collect()}
    assert got == {"a": ([1.0, 2.0], '{"k":1}'), "c": ([], None)}
    back = store.to_json_rows(store.from_json_rows(rows)).orderBy("unit_id").collect()
    assert [(r.vector, r.metadata) for r in back] == [("[1.0,2.0]", '{"k":1}'), ("[]", "{}")]
    assert all("IF NOT EXISTS" in store.ddl("t", 3, d) for d in ("spark", "pgvector", "sqlite"))
    for bad in (("t; drop", 3), ("t", 0)):
        with pytest.raises(ValueError):
            store.ddl(*bad)


def test_database_queries():
    f = [MetadataFilter("lang", "eq", "o'x"), MetadataFilter("n", "in", [1, 2]), MetadataFilter("tags", "any_of", ["a"]), MetadataFilter("x", "like", "y")]
    assert [store.jdbc_predicate(x) for x in f] == ["metadata ->> 'lang' = 'o''x'", "metadata ->> 'n' = ANY(ARRAY['1', '2']::text[])", "metadata -> 'tags' ?| ARRAY['a']::text[]", "FALSE"]
    asked = store.jdbc_query("t", [1, 2.5], 3, f[:1])
    assert "<=> '[1.0,2.5]'" in asked and "WHERE metadata ->> 'lang' = 'o''x' ORDER BY" in asked and asked.endswith("LIMIT 3")
    with pytest.raises(ValueError):
        store.jdbc_query("t; drop", [1], 3)


def rag(spark, tmp_path, **more):
    kept = store.TableStore(spark, f"chunks_{tmp_path.name.replace('-', '_')}", str(tmp_path / "store"))
    search = lambda c, q: retrieve.vector(c, q, embed.letter_frequency)
    return Pipeline(lambda d: chunk.fixed(d, 8), embed.letter_frequency, kept, search, **more)


def corpus(spark):
    return spark.createDataFrame([("doc1", "aaaaaaaaaaaa"), ("doc2", "bbbbbbbb"), ("doc3", "abababab")], "document_id string, content string")


def test_pipeline(spark, tmp_path):
    calls = []
    hook = Hook(lambda n: calls.append(("bi", n)), lambda n, e: calls.append(("ai", n, e)), lambda q: calls.append("br"), lambda n, e: calls.append(("ar", n, e)), None, lambda n, e: calls.append(("rr", n)))
    p = rag(spark, tmp_path, hooks=[hook, log_hook()], reranker=lambda f, q: f)
    assert p.ingest(corpus(spark)) == 4
    queries = spark.createDataFrame([("q", "aaa", 10)], "query_id string, text string, top_k int")
    assert [r.unit_id for r in p.retrieve(queries)] == ["doc1-0", "doc1-1", "doc3-0", "doc2-0"]
    p.ingest(spark.createDataFrame([("doc1", "aaa")], "document_id string, content string"))
    assert [r.unit_id for r in p.retrieve(queries)] == ["doc1-0", "doc3-0", "doc2-0"]
    p.delete(["doc1"])
    assert [r.unit_id for r in p.retrieve(queries)] == ["doc3-0", "doc2-0"]
    assert calls[:3] == [("bi", 3), ("ai", 4, None), "br"] and ("rr", 4) in calls
    with pytest.raises(ValueError):
        Pipeline(None, embed.letter_frequency, p.store, p.retriever)


def test_pipeline_access(spark, tmp_path):
    grants = Allowlist(pairs(spark, [("u", "doc1"), ("u", "doc3")]))
    queries = spark.createDataFrame([("q", "bbb", 2, "u")], "query_id string, text string, top_k int, subject string")
    post = rag(spark, tmp_path, authorizer=grants)
    post.ingest(corpus(spark))
    assert [(r.unit_id, r.rank) for r in post.retrieve(queries)] == [("doc3-0", 2)]  # doc2 held rank 1
    post.mode = Mode.PRE_FILTER
    assert [r.unit_id for r in post.retrieve(queries)] == ["doc3-0", "doc1-0"]
    post.mode = Mode.HYBRID
    assert [r.unit_id for r in post.retrieve(queries)] == ["doc3-0"]
    policies = pairs(spark, [("u", "doc2", "read")], "subject string, resource string, action string")
    post.mode, post.authorizer = Mode.PRE_FILTER, RoleBased(policies, pairs(spark, [("x", "y")], "subject string, role string"))
    assert [r.unit_id for r in post.retrieve(queries)] == ["doc2-0"]


def test_failing_ingest_reports(spark, tmp_path):
    seen = []
    p = rag(spark, tmp_path, hooks=[Hook(after_ingest=lambda n, e: seen.append((n, type(e).__name__)))])
    with pytest.raises(Exception):
        p.ingest(corpus(spark).withColumn("content", F.raise_error(F.lit("broken")).cast("string")))
    assert seen and seen[0][0] == 0


def test_stream(spark, tmp_path):
    kept = store.TableStore(spark, "streamed", str(tmp_path / "store"))
    corpus(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    for more in (None, [("doc1", "aaaaaaaaaaaa"), ("doc4", "dddd")]):
        if more:
            spark.createDataFrame(more, "document_id string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.document_stream(spark, str(tmp_path / "in"), "document_id string, content string")
        query = ingest.ingest_stream(stream, lambda d: chunk.fixed(d, 8), kept, str(tmp_path / "check"))
        query.awaitTermination(120)
    assert sorted(r.unit_id for r in kept.chunks().collect()) == ["doc1-0", "doc1-1", "doc2-0", "doc3-0", "doc4-0"]


@pytest.fixture
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            calls.append((self.command, self.path, body, dict(self.headers)))
            code, answer = 200, {}
            if self.path == "/api/embed":
                answer = {"embeddings": [[float(len(t)), 0.0] for t in body["input"]]}
            elif self.path == "/embeddings":
                answer = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path.endswith("/points/query"):
                answer = {"result": {"points": [{"id": "c1", "score": 0.9, "payload": {"source_doc_id": "d", "source_uri": "u", "content": "text", "lang": "en"}}]}}
            elif self.path.endswith("/check"):
                answer = {"allowed": body["tuple_key"]["object"] == "document:1"}
            elif self.path.endswith("/list-objects"):
                answer = {"objects": ["document:1", "document:2"]}
            elif self.path.endswith("/bad"):
                code, answer = 500, {"why": "broken"}
            data = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_POST = do_PUT = _answer

        def log_message(self, *args):
            pass

    srv = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{srv.server_port}", calls
    srv.shutdown()


def test_http_connectors(spark, server):
    url, calls = server
    assert http.ollama_embedder("m", url)(["ab", "c"]) == [[2.0, 0.0], [1.0, 0.0]] and http.ollama_embedder("m", url)([]) == []
    assert http.openai_embedder("m", "key", url)(["ab", "c"]) == [[2.0], [1.0]] and calls[-1][3]["Authorization"] == "Bearer key"
    assert [http.dimensions(m) for m in ("text-embedding-3-small", "text-embedding-3-large", "other")] == [1536, 3072, 1536]
    q = http.Qdrant(url + "/", "c", 2, "secret")
    q.ensure()
    assert calls[-1][:3] == ("PUT", "/collections/c", {"vectors": {"size": 2, "distance": "Cosine"}}) and calls[-1][3]["Api-Key"] == "secret"
    chunks = spark.sql("""SELECT 'c1' AS unit_id, 'd' AS source_doc_id, 'u' AS source_uri, 't' AS text, array(1f, 2f) AS vector, parse_json('{"lang":"en","content":"own"}') AS metadata""")
    assert q.store(chunks) == 1
    assert calls[-1][2] == {"points": [{"id": "c1", "vector": [1.0, 2.0], "payload": {"source_doc_id": "d", "source_uri": "u", "content": "own", "lang": "en"}}]}
    row = q.search(spark, [1.0, 0.0], 0, MetadataFilter("lang", "in", ["en"])).withColumn("m", F.to_json("metadata")).first()
    assert (row.unit_id, row.text, row.score, row.m) == ("c1", "text", 0.9, '{"lang":"en"}') and calls[-1][2]["limit"] == 10 and calls[-1][2]["filter"] == {"must": [{"key": "lang", "match": {"any": ["en"]}}]}
    q.delete(["c1"])
    assert calls[-1][:3] == ("POST", "/collections/c/points/delete", {"points": ["c1"]})
    with pytest.raises(RuntimeError, match="500.*broken"):
        http.request("POST", url + "/bad", {})
    with pytest.raises(ValueError):
        http.Qdrant("", "c", 2)


def test_relationship_service(spark, server):
    url, calls = server
    r = http.RelationshipService(url, "s", "model", "key")
    assert r.check("user:a", "reader", "document:1") and not r.check("user:a", "reader", "document:2")
    assert calls[-1][2]["authorization_model_id"] == "model" and r.filter("user:a", "reader", ["document:1", "document:2"]) == ["document:1"]
    assert r.filter("user:a", "reader", None) == ["document:1", "document:2"]
    assert sorted(x.resource for x in r.grants(spark, ["user:a"]).collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        http.RelationshipService("", "s")


def test_tenants_in_hybrid_mode(spark, tmp_path):
    """A retriever that knows no tenants is kept to the query's own."""
    p = rag(spark, tmp_path, authorizer=Allowlist(pairs(spark, [("u", "doc1"), ("u", "doc2"), ("u", "doc3")])), mode=Mode.HYBRID)
    p.ingest(corpus(spark).withColumn("tenant_id", F.when(F.col("document_id") == "doc3", "b").otherwise("a")))
    p.retriever = lambda c, q: retrieve.vector(c.drop("tenant_id"), q.drop("tenant_id"), embed.letter_frequency)
    queries = spark.createDataFrame([("q1", "aaa", 2, "u", "a"), ("q2", "aaa", 2, "u", "b"), ("q3", "aaa", 4, "u", None), ("q4", "aaa", 9, "nobody", "a")], "query_id string, text string, top_k int, subject string, tenant_id string")
    got = [(r.query_id, r.unit_id) for r in p.retrieve(queries)]
    assert got == [("q1", "doc1-0"), ("q1", "doc1-1"), ("q2", "doc3-0"), ("q3", "doc1-0"), ("q3", "doc1-1"), ("q3", "doc3-0"), ("q3", "doc2-0")]


def test_subjects_in_pre_filter_mode(spark, tmp_path):
    p = rag(spark, tmp_path, authorizer=Allowlist(pairs(spark, [("u", "doc1"), ("v", "doc2")])), mode=Mode.PRE_FILTER)
    p.ingest(corpus(spark))
    queries = spark.createDataFrame([("q1", "aaa", 9, "u"), ("q2", "aaa", 9, "v"), ("q3", "aaa", 9, None)], "query_id string, text string, top_k int, subject string")
    assert [(r.query_id, r.unit_id) for r in p.retrieve(queries)] == [("q1", "doc1-0"), ("q1", "doc1-1"), ("q2", "doc2-0")]


def test_database_store(spark, tmp_path):
    kept = database.DatabaseStore(spark, functools.partial(sqlite3.connect, str(tmp_path / "a.db"), timeout=60), "notes", 2, "sqlite")
    kept.ensure()
    kept.ensure()
    make = lambda rows: spark.createDataFrame(rows, "unit_id string, source_doc_id string, text string, vector array<float>, lang string").withColumn("metadata", F.parse_json(F.to_json(F.struct("lang"))))
    kept.store(make([(f"c{i}", f"d{i % 3}", f"it's {i}", [1.0, float(i)], "en") for i in range(1200)]))
    kept.store(make([("c1", "d1", "new", [0.0, 1.0], "fr"), ("x", "d9", "more", None, None)]))
    rows = {r.unit_id: r for r in kept.chunks().select("unit_id", "text", "vector", F.to_json("metadata").alias("m")).collect()}
    assert len(rows) == 1201 and rows["c1"].text == "new" and rows["c2"].vector == [1.0, 2.0] and rows["c1"].m == '{"lang":"fr"}'
    assert [r.unit_id for r in kept.search([0.0, 1.0], 1).collect()] == ["c1"]
    assert [r.unit_id for r in kept.search([1.0, 0.0], 2, [MetadataFilter("lang", "eq", "fr")]).collect()] == ["c1"]
    kept.delete(["c1", "absent"])
    kept.delete_documents(["d0", "d'"])
    kept.replace_documents(make([("y", "d1", "only", [1.0, 1.0], "en")]))
    left = [r.unit_id for r in kept.chunks().collect()]
    assert sorted(left)[-2:] == ["x", "y"] and len(left) == 402
    assert database.upsert_statement("t", "pgvector").startswith("INSERT INTO t (unit_id, source_doc_id, source_uri, text, metadata, vector) VALUES (%s, %s, %s, %s, %s::jsonb, %s::vector) ON CONFLICT (unit_id) DO UPDATE SET source_doc_id = excluded.source_doc_id")
    with pytest.raises(ValueError):
        database.DatabaseStore(spark, None, "t; drop", 2)


def test_database_deletes_by_index_and_reads_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(database, "PART", 100)
    connect = functools.partial(sqlite3.connect, str(tmp_path / "a.db"), timeout=60)
    kept = database.DatabaseStore(spark, connect, "main.notes", 2, "sqlite")
    kept.ensure()
    assert kept.chunks().collect() == []
    make = lambda rows: spark.createDataFrame(rows, "unit_id string, source_doc_id string, text string, vector array<float>")
    kept.store(make([(f"c{i % 750}", f"d{i % 750}", f"t{i}", [1.0, 2.0]) for i in range(1500)]))  # each id twice
    with contextlib.closing(connect()) as c:
        for column in ("unit_id", "source_doc_id"):
            plan = c.execute("EXPLAIN QUERY PLAN " + database.delete_statement("main.notes", "sqlite", column), ("d1",)).fetchall()
            assert "USING INDEX" in plan[0][3], plan  # and no scan
    rows = kept.chunks()
    assert rows.rdd.getNumPartitions() == 8
    kept.delete_documents(["d0"])
    kept.store(make([("late", "d9", "later than the plan", [0.0, 1.0])]))
    got = {r.unit_id: r.text for r in rows.collect()}
    assert len(got) == rows.count() == 750 and "c0" not in got and "late" in got
    assert all(got[f"c{i}"] in (f"t{i}", f"t{i + 750}") for i in range(1, 750))
    assert database.index_statement("s.notes", "pgvector") == "CREATE INDEX IF NOT EXISTS notes_source_doc_id ON s.notes (source_doc_id)"


def test_files_of_a_database_are_where_executors_see_them(tmp_path):
    make = lambda place, master="local-cluster[3,2,1024]": session.shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": place}, sparkContext=SimpleNamespace(master=master)))
    for place in (str(tmp_path / "a b"), f"file://{tmp_path}/a%20b/"):
        made = make(place)
        assert made.startswith(f"{tmp_path}/a b/") and os.path.isdir(made)
    assert os.path.isdir(make(None, "local[4]"))
    for place in (None, "hdfs://far/shared"):  # nowhere that all see
        with pytest.raises(ValueError):
            make(place)


def test_store_rewrites_what_it_touches(spark, tmp_path):
    where = str(tmp_path / "kept")
    make = lambda rows: spark.createDataFrame(rows, "unit_id string, source_doc_id string, text string")
    kept = store.TableStore(spark, "bucketed", where)
    kept.store(make([(f"u{i}", f"d{i}", "old") for i in range(200)]))
    before = dict(kept.paths)
    kept.replace_documents(make([("v0", "d7", "new"), ("v1", "d7", "new")]))
    assert sum(kept.paths[b] != before[b] for b in before) == 1
    kept.store(make([("u3", "d100", "moved")]))  # from another document's bucket
    kept.delete_documents(["d5", "absent"])
    rows = {r.unit_id: (r.source_doc_id, r.text) for r in kept.chunks().collect()}
    assert len(rows) == 200 and rows["u3"] == ("d100", "moved") and rows["v1"] == ("d7", "new") and "u7" not in rows and "u5" not in rows
    # of two that begin from the same version, one fails
    other = store.TableStore(spark, "bucketed", where)
    kept.delete(["u9"])
    with pytest.raises(store.ConcurrentChange):
        other.delete(["u10"])
    kept.expire()
    again = store.TableStore(spark, "bucketed", where)
    assert again.number == kept.number and again.chunks().count() == 199
    again.store(make([("w", "d1", "x")]).withColumn("lang", F.lit("en")))  # another column
    assert {r.unit_id: r.lang for r in again.chunks().collect()}["u1"] is None and again.chunks().where("lang = 'en'").count() == 1
    again.delete([r.unit_id for r in again.chunks().collect()])
    assert again.chunks().collect() == [] and store.TableStore(spark, "bucketed", where).chunks().columns == ["unit_id", "source_doc_id", "text", "lang"]
