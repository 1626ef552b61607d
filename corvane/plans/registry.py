"""Queries by name over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import json
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, serde
from ..functions.expr import MetadataFilter
from ..operators import auth, chunk, embed, evaluate, rerank, retrieve
from ..sources import database, http, store
from ..sources import documents as docs_source
from ..streaming import ingest
from . import pipeline as plan
from . import sql
from .session import reachable, shared_folder, spread

#: Scores are compared as they are rounded, so that equal ones are equal in any engine.
DIGITS = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as documents; language and source are columns and metadata."""
    rows = spread(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), "lang", "source", "doc_id",
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"),
    )


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks."""
    return _documents(spark, sf_dir).select(F.col("document_id").alias("unit_id"), F.col("document_id").alias("source_doc_id"), "source_uri", F.col("content").alias("text"), "lang", "source", "doc_id")


def _questions(spark: SparkSession, sf_dir: str, top_k: int = 10) -> DataFrame:
    """The benchmark items as queries."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", F.lit(top_k).alias("top_k"))


def _bytes_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("unit_id", "source_doc_id", F.col("position.start_byte").alias("start_byte"), F.col("position.end_byte").alias("end_byte"), F.lower(F.hex("data")).alias("data"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "unit_id", F.round("score", DIGITS).alias("score"))


# documents and text


def doc_fingerprint(s, d):
    return _documents(s, d).select("document_id", F.lower(F.hex(expr.fingerprint("content"))).alias("fingerprint"), F.octet_length("content").cast("long").alias("size"))


def doc_construct(s, d):
    made = docs_source.documents_from(_documents(s, d), "document_id", "content", tenant_id="source", language="lang", source_uri="source_uri")
    return made.select("document_id", "mime_type", "size", "tenant_id", "language", "source_uri")


def doc_changed_anti(s, d):
    """Documents that differ from the stored ones: those in German were stored otherwise."""
    now = _documents(s, d).withColumn("fingerprint", expr.fingerprint("content"))
    before = _documents(s, d).withColumn("fingerprint", expr.fingerprint(F.when(F.col("lang") == "de", F.concat("content", F.lit("."))).otherwise(F.col("content"))))
    return docs_source.changed(now, before).select("document_id", "lang")


def token_count(s, d):
    return _documents(s, d).select("document_id", expr.token_count("content").alias("n_tokens"))


def token_count_approx(s, d):
    return _documents(s, d).select("document_id", expr.approximate_count("content").alias("n_tokens"))


def bm25_tokens(s, d):
    return _documents(s, d).select("document_id", F.size(expr.tokens("content")).alias("n_tokens"), F.size(F.array_distinct(expr.tokens("content"))).alias("n_distinct"))


def parse_score(s, d):
    return _documents(s, d).select("document_id", expr.parse_score("content").alias("score"))


# chunkers


def chunk_fixed(s, d):
    return _bytes_of(chunk.fixed(_documents(s, d), 512, 0))


def chunk_fixed_overlap(s, d):
    return _bytes_of(chunk.fixed(_documents(s, d), 512, 64))


def chunk_sentence(s, d):
    return _bytes_of(chunk.sentence(_documents(s, d), 512, 0))


def chunk_sentence_overlap(s, d):
    return _bytes_of(chunk.sentence(_documents(s, d), 256, 2))


def chunk_recursive(s, d):
    return _bytes_of(chunk.recursive(_documents(s, d), 512, 0))


def chunk_recursive_overlap(s, d):
    return _bytes_of(chunk.recursive(_documents(s, d), 400, 50))


def chunk_semantic(s, d):
    return _bytes_of(chunk.semantic(_documents(s, d), embed.letter_frequency, 600, 0.7))


def chunk_late(s, d):
    chunks = chunk.late(_documents(s, d), embed.letter_frequency, 512, 64)
    return chunks.select("unit_id", F.try_variant_get("metadata", "$.late_chunking", "boolean").alias("late"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("letters"))


def chunk_contextual(s, d):
    prefix = lambda content, text: F.concat(F.lit("of "), F.octet_length(content).cast("string"), F.lit(" bytes"))
    chunks = chunk.contextual(_documents(s, d), prefix, 512, 64)
    return chunks.select("unit_id", "context_prefix", F.octet_length("data").alias("n_bytes"))


def chunk_proposition(s, d):
    return chunk.proposition(_documents(s, d), expr.sentences).select("unit_id", "source_doc_id", "text", F.col("position.end_byte").alias("end_byte"))


# words


def bm25_tf(s, d):
    return retrieve.Bm25Index.build(_units(s, d)).postings.select("term", "unit_id", "tf")


def bm25_df(s, d):
    return retrieve.Bm25Index.build(_units(s, d)).terms


def bm25_stats(s, d):
    return retrieve.Bm25Index.build(_units(s, d)).totals.select("n", F.round("mean", DIGITS).alias("mean"))


def _bm25(s, d, filters=(), **settings) -> DataFrame:
    return retrieve.bm25(retrieve.Bm25Index.build(_units(s, d)), _questions(s, d), filters, digits=DIGITS, **settings)


def bm25_topk(s, d):
    return _ranked(_bm25(s, d))


def bm25_filtered(s, d):
    return _ranked(_bm25(s, d, [MetadataFilter("lang", "in", ["en", "fr"])]))


def bm25_repeated_terms(s, d):
    """Every query is asked twice over in one text, so that all its terms count twice."""
    twice = _questions(s, d).withColumn("text", F.concat_ws(" ", "text", "text"))
    return _ranked(retrieve.bm25(retrieve.Bm25Index.build(_units(s, d)), twice, digits=DIGITS))


# vectors


def _vectors(s, d) -> DataFrame:
    return _table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.col("vec_id").cast("string").alias("source_doc_id"), F.lit("").alias("text"), F.col("embedding").alias("vector"), "label", "vec_id")


def _vector_queries(s, d) -> DataFrame:
    return _vectors(s, d).where("vec_id % 50 = 0").select(F.col("unit_id").alias("query_id"), F.lit("").alias("text"), F.lit(10).alias("top_k"), "vector")


def knn_batch(s, d):
    return _ranked(retrieve.vector(_vectors(s, d), _vector_queries(s, d), digits=DIGITS))


def knn_filtered(s, d):
    return _ranked(retrieve.vector(_vectors(s, d), _vector_queries(s, d), filters=[MetadataFilter("label", "in", [1, 2, 3, 4]), MetadataFilter("label", "in", [3, 4, 5])], digits=DIGITS))


def knn_topk(s, d):
    """The ten vectors nearest to the mean of all."""
    rows = _vectors(s, d)
    mean = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.round(F.avg("x"), 4).alias("x"))
    query = [r["x"] for r in mean.orderBy("at").collect()]  # as many values as a vector has
    return store.search(rows, query, 10).select("unit_id", F.round("score", DIGITS).alias("score"))


# metadata


def _with_variant(s, d) -> DataFrame:
    return _documents(s, d).withColumn("metadata", F.parse_json(F.to_json(F.struct("lang", "source", F.array("lang", "source").alias("tags"), F.col("doc_id").alias("number")))))


def _matching(s, d, *filters) -> DataFrame:
    return _with_variant(s, d).select("document_id", "metadata").where(expr.match_all(filters)).select("document_id")


def filter_eq(s, d):
    return _matching(s, d, MetadataFilter("lang", "eq", "fr"))


def filter_in(s, d):
    return _matching(s, d, MetadataFilter("source", "in", ["src1", "src2", "src3"]))


def filter_any_of(s, d):
    return _matching(s, d, MetadataFilter("tags", "any_of", ["de", "src7"]))


def filter_all(s, d):
    return _matching(s, d, MetadataFilter("lang", "eq", "en"), MetadataFilter("tags", "any_of", ["src0", "src4"]))


def filter_missing(s, d):
    return _matching(s, d, MetadataFilter("absent", "eq", "x"))


def filter_events(s, d):
    """A field of a JSON text, compared as a string."""
    events = _table(s, d, "events").withColumn("metadata", F.parse_json("props"))
    return events.where(MetadataFilter("k", "eq", 42).column()).select("event_id")


# fusion and the other retrievers


def _lists(s, d) -> list[DataFrame]:
    """Two rankings of documents for the benchmark items: by words, and by letters."""
    chunks = embed.embed_chunks(_units(s, d), embed.letter_frequency)
    near = retrieve.vector(chunks, _questions(s, d), embed.letter_frequency, digits=DIGITS)
    return [_bm25(s, d), near]


def vector_letters(s, d):
    return _ranked(_lists(s, d)[1])


def hybrid_rrf(s, d):
    return _ranked(retrieve.hybrid(_questions(s, d), _lists(s, d), digits=DIGITS))


def ensemble(s, d):
    return _ranked(retrieve.ensemble(_questions(s, d), _lists(s, d)))


def router(s, d):
    """Queries that contain "the" go to words, all others to letters."""
    chunks = embed.embed_chunks(_units(s, d), embed.letter_frequency)
    index = retrieve.Bm25Index.build(_units(s, d))
    routes = [
        retrieve.Route("words", lambda q: retrieve.bm25(index, q, digits=DIGITS), lambda t: F.contains(F.lower(t), F.lit(" the "))),
        retrieve.Route("letters", lambda q: retrieve.vector(chunks, q, embed.letter_frequency, digits=DIGITS), lambda t: F.lit(True)),
    ]
    return _ranked(retrieve.router(_questions(s, d), routes))


def _facts(s, d) -> DataFrame:
    """Nations in regions, and suppliers in nations, as facts."""
    nation, region, supplier = _table(s, d, "nation"), _table(s, d, "region"), _table(s, d, "supplier")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("unit_id"), F.col("n_name").alias("subject"), F.lit("in region").alias("predicate"), F.col("r_name").alias("object"))
    seats = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("unit_id"), F.col("s_name").alias("subject"), F.lit("based in").alias("predicate"), F.col("n_name").alias("object"))
    return places.unionByName(seats).withColumn("source_doc_id", F.lit("geography"))


def graph_match(s, d):
    asked = _table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("query_id"), F.concat(F.lit("region "), F.col("r_name"), F.lit(" nation")).alias("text"), F.lit(20).alias("top_k"))
    return _ranked(retrieve.graph(_facts(s, d), asked))


def fact_text(s, d):
    return _facts(s, d).select("unit_id", expr.fact_text().alias("as_text"))


def small_to_big(s, d):
    """Sentences are found, their documents returned."""
    children = chunk.proposition(_documents(s, d), expr.sentences).withColumn("parent_id", F.col("source_doc_id"))
    found = retrieve.bm25(retrieve.Bm25Index.build(children), _questions(s, d, 20), digits=DIGITS)
    return _ranked(retrieve.small_to_big(found, _units(s, d)))


TPCH_LIKE = """
SELECT o_orderpriority AS priority, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority ORDER BY o_orderpriority
"""


def structured_sql(s, d):
    for name in ("orders", "lineitem", "customer"):
        _table(s, d, name).createOrReplaceTempView(name)
    return s.sql(TPCH_LIKE)


def structured_units(s, d):
    for name in ("orders", "customer"):
        _table(s, d, name).createOrReplaceTempView(name)
    text_to_sql = lambda text: "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment"
    return retrieve.structured(s, "q1", "customers by segment", text_to_sql, "warehouse").select("query_id", "rank", "unit_id", "source_doc_id", "as_text", "score")


def web_results(s, d):
    """The ten first pages of each region, as results of a search."""
    pages, region = _table(s, d, "pages"), _table(s, d, "region")
    hits = region.join(pages, F.col("page_id") % 5 == F.col("r_regionkey"))
    by = F.row_number().over(retrieve.Window.partitionBy("r_regionkey").orderBy("page_id")) - 1
    found = hits.select(F.col("r_regionkey").cast("string").alias("query_id"), by.alias("at"), "url", F.lit("").alias("title"), F.col("html").alias("snippet")).where("at < 10")
    return retrieve.web_units(found).select("query_id", "rank", "unit_id", "source_doc_id", F.round("score", DIGITS).alias("score"), F.lower(F.sha2("as_text", 256)).alias("text_sha256"))


# reranking, access, evaluation


def litm_reorder(s, d):
    return _ranked(rerank.lost_in_the_middle(_bm25(s, d)))


def crossencoder(s, d):
    """Scores by how many of the query's distinct words a document has."""

    def overlap(query, text):
        return F.size(F.array_intersect(expr.tokens(query), expr.tokens(text))) / F.size(F.array_distinct(expr.tokens(query)))

    return _ranked(rerank.cross_encoder(_bm25(s, d), _questions(s, d), lambda q, t: F.round(overlap(q, t), DIGITS), top_k=5, threshold=0.1))


def _subjects(s, d) -> DataFrame:
    """Queries with a subject each, of five."""
    return _questions(s, d).withColumn("subject", F.concat(F.lit("user"), (F.col("query_id").cast("long") % 5).cast("string")))


def _grants(s, d) -> DataFrame:
    """Each subject may read the documents of a fifth of the sources."""
    number = F.substring("source", 4, 9).cast("int") % 5
    return _documents(s, d).select(F.concat(F.lit("user"), number.cast("string")).alias("subject"), F.col("document_id").alias("resource"))


def auth_post(s, d):
    return _ranked(auth.post_filter(_bm25(s, d), _subjects(s, d), auth.Allowlist(_grants(s, d))))


def auth_pre(s, d):
    """Statistics are those of all documents; candidates only the permitted ones."""
    index = retrieve.Bm25Index.build(_units(s, d))
    seen = auth.permitted_chunks(index.chunks, "user3", auth.Allowlist(_grants(s, d)))
    return _ranked(retrieve.bm25(index.within(seen), _questions(s, d), digits=DIGITS))


def auth_roles(s, d):
    """Even subjects have the role of a language, whose documents it may read; user4
    may do anything; odd subjects see nothing."""
    policies = _documents(s, d).select(F.col("lang").alias("subject"), F.col("document_id").alias("resource"), F.lit("read").alias("action"))
    policies = policies.unionByName(s.createDataFrame([("admin", "*", "*")], "subject string, resource string, action string"))
    roles = s.createDataFrame([("user0", "en"), ("user2", "fr"), ("user4", "admin")], "subject string, role string")
    return _ranked(auth.post_filter(_bm25(s, d), _subjects(s, d), auth.RoleBased(policies, roles)))


def auth_tenant(s, d):
    """Each query sees the documents of its own source."""
    asked = _questions(s, d).withColumn("tenant_id", F.concat(F.lit("src"), (F.col("query_id").cast("long") % 20).cast("string")))
    index = retrieve.Bm25Index.build(_units(s, d).withColumn("tenant_id", F.col("source")))
    return _ranked(retrieve.bm25(index, asked, digits=DIGITS))


def _cases(s, d) -> DataFrame:
    """Benchmark items as cases."""
    return _table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("reference_answer"), F.lit(None).cast("array<string>").alias("relevant_document_ids"))


def _relevant(s, d) -> DataFrame:
    """The documents of one source are relevant to each item."""
    items = _table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), (F.col("item_id") % 20).cast("int").alias("number"))
    return _documents(s, d).select("document_id", F.substring("source", 4, 9).cast("int").alias("number")).join(items, "number").select("case_id", "document_id")


def eval_precision_recall(s, d):
    index = retrieve.Bm25Index.build(_units(s, d))
    out = evaluate.evaluate(_cases(s, d), lambda q: retrieve.bm25(index, q, digits=DIGITS), relevant=_relevant(s, d))
    return out.select("case_id", F.round("context_precision", DIGITS).alias("context_precision"), F.round("context_recall", DIGITS).alias("context_recall"))


def eval_context(s, d):
    return evaluate.contexts(_bm25(s, d)).select("case_id", F.sha2("context", 256).alias("context_sha256"))


def eval_judged(s, d):
    """Answers say how many words the context has; the judge says how many the
    prompt has."""
    index = retrieve.Bm25Index.build(_units(s, d))
    words = lambda text: F.size(F.split(text, " ")).cast("string")
    answer = lambda question, context: F.concat(F.lit("It has "), words(context), F.lit(" words."))
    judge = lambda prompt: F.concat(F.lit("Score: "), words(prompt))
    out = evaluate.evaluate(_cases(s, d), lambda q: retrieve.bm25(index, q, digits=DIGITS), 10, answer, judge)
    return out.select("case_id", "answer", "faithfulness", "relevance")


def score_history(s, d):
    """Every entry of the fused results' provenance."""
    found = retrieve.hybrid(_questions(s, d), _lists(s, d), digits=DIGITS)
    return found.select("query_id", "unit_id", F.posexplode("scores").alias("at", "entry")).select("query_id", "unit_id", "at", F.col("entry.stage").alias("stage"), F.round("entry.score", DIGITS).alias("score"))


def auth_grants(s, d):
    """Documents in English are granted to user0 too, and those of source 10 revoked from it."""
    documents = _documents(s, d)
    more = documents.where("lang = 'en'").select(F.lit("user0").alias("subject"), F.col("document_id").alias("resource"))
    less = documents.where("source = 'src10'").select(F.lit("user0").alias("subject"), F.col("document_id").alias("resource"))
    return _ranked(auth.post_filter(_bm25(s, d), _subjects(s, d), auth.Allowlist(_grants(s, d)).grant(more).revoke(less)))


def auth_everything(s, d):
    """Nothing is filtered where everything is permitted."""
    return _ranked(auth.post_filter(_bm25(s, d), _subjects(s, d), auth.Noop()))


def vector_codec(s, d):
    """Vectors as texts and back, and their numbers as floats."""
    rows = _vectors(s, d).select("unit_id", expr.vector_from(expr.vector_literal("vector")).alias("vector"))
    return rows.select("unit_id", F.size("vector").alias("n"), F.round(F.aggregate(F.transform(expr.narrow("vector"), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def metadata_codec(s, d):
    """Chunks as rows of texts and back; damaged vectors leave, damaged metadata is null."""
    chunks = _with_variant(s, d).select(F.col("document_id").alias("unit_id"), F.array(F.col("doc_id").cast("float"), F.lit(0.5).cast("float")).alias("vector"), "metadata", "lang", "doc_id")
    stored = store.to_json_rows(chunks).withColumn("vector", F.when(F.col("lang") == "de", "[1,").otherwise(F.col("vector"))).withColumn("metadata", F.when(F.col("lang") == "fr", "{").otherwise(F.col("metadata")))
    back = store.from_json_rows(stored)
    return back.select("unit_id", F.element_at("vector", 1).cast("long").alias("first"), F.try_variant_get("metadata", "$.source", "string").alias("source"), F.try_variant_get("metadata", "$.number", "long").alias("number"))


FILTERS = [MetadataFilter("lang", "eq", "f'r"), MetadataFilter("n", "eq", 4), MetadataFilter("on", "eq", True), MetadataFilter("lang", "in", ["en", "fr"]), MetadataFilter("tags", "any_of", ["a", "b"]), MetadataFilter("x", "like", "y"), MetadataFilter("lang", "eq", ["en"])]


def filter_translations(s, d):
    """Filters as a database and a vector service read them."""
    rows = [(i, store.jdbc_predicate(f), json.dumps(http.point_filter(f), sort_keys=True)) for i, f in enumerate(FILTERS)]
    return s.createDataFrame(rows, "number int, predicate string, condition string")


def chunk_tables(s, d):
    """What makes an empty chunk table, by dialect."""
    return s.createDataFrame([(x, store.ddl("notes", 3, x)) for x in ("pgvector", "sqlite", "spark")], "dialect string, statement string")


def web_search(s, d):
    """A search that answers with the query's words, asked on the executors."""

    def search(text: str, k: int) -> list[tuple[str, str, str]]:
        return [(f"web://{w}/{i}", w, text) for i, w in enumerate(text.split(" ")[:k])]

    asked = _table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("query_id"), F.concat_ws(" ", "n_name", F.lit("seen"), "n_name").alias("text"), F.lit(2).alias("top_k"))
    return retrieve.web(asked, search).select("query_id", "rank", "unit_id", "source_uri", "as_text", F.round("score", DIGITS).alias("score"))


# the pipeline and its store


def _pipeline(s, d, **settings) -> plan.Pipeline:
    """Fixed chunks with letter vectors in a store of its own, searched by vector."""
    kept = store.TableStore(s, f"notes_{uuid.uuid4().hex}")
    return plan.Pipeline(lambda docs: chunk.fixed(docs, 1024, 0), embed.letter_frequency, kept, lambda chunks, asked: retrieve.vector(chunks, asked, embed.letter_frequency, digits=DIGITS), **settings)


def _notes(s, d) -> DataFrame:
    return _documents(s, d).withColumn("tenant_id", F.col("source"))


def _stored(made: plan.Pipeline) -> DataFrame:
    return made.store.chunks().select("unit_id", "source_doc_id", F.octet_length("data").alias("n_bytes"))


def pipeline_ingest(s, d):
    """Documents are ingested, the beginnings of French ones again, and some of one
    source deleted; hooks count the chunks."""
    counts: list[int] = []
    made = _pipeline(s, d, hooks=[plan.log_hook(), plan.Hook(after_ingest=lambda n, error: counts.append(n))])
    made.ingest(_notes(s, d))
    made.ingest(_notes(s, d).where("lang = 'fr'").withColumn("content", F.concat(F.lit("again "), F.substring("content", 1, 700))))
    made.delete([r["document_id"] for r in _notes(s, d).where("source = 'src3' and lang = 'en'").select("document_id").collect()])
    return _stored(made).withColumn("n_ingested", F.lit(sum(counts)).cast("long"))


def pipeline_tenants(s, d):
    """In hybrid mode each query sees its tenant's chunks alone, whatever the retriever,
    and of those only what its subject may see."""
    made = _pipeline(s, d, authorizer=auth.Allowlist(_notes(s, d).where("lang <> 'de'").select(F.lit("reader").alias("subject"), F.col("document_id").alias("resource"))), mode=auth.Mode.HYBRID)
    made.ingest(_notes(s, d))
    made.retriever = lambda chunks, asked: retrieve.vector(chunks.drop("tenant_id"), asked, embed.letter_frequency, digits=DIGITS)  # one that knows no tenants
    asked = _questions(s, d).withColumn("tenant_id", F.concat(F.lit("src"), (F.col("query_id").cast("long") % 3).cast("string"))).withColumn("subject", F.lit("reader"))
    return made.plan(asked).select("query_id", "rank", "unit_id", F.round("score", DIGITS).alias("score"))


def pipeline_subjects(s, d):
    """Pre-filtering for several subjects: each searches what it may see."""
    made = _pipeline(s, d, authorizer=auth.Allowlist(_grants(s, d)), mode=auth.Mode.PRE_FILTER)
    made.ingest(_notes(s, d))
    return made.plan(_subjects(s, d)).select("query_id", "rank", "unit_id", F.round("score", DIGITS).alias("score"))


def stream_ingest(s, d):
    """Documents that arrive as files are chunked and stored. The path is a pattern, so
    that it may name a file as well as a folder."""
    kept = store.TableStore(s, f"stream_{uuid.uuid4().hex}")
    arriving = ingest.document_stream(reachable(s), f"{d}/document[s].parquet", "doc_id long, text string").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    ingest.ingest_stream(arriving, lambda docs: chunk.fixed(docs, 2048, 0), kept, f"{kept.location}/progress").awaitTermination()
    return kept.chunks().select("unit_id", "source_doc_id", F.octet_length("data").alias("n_bytes"))


def database_store(s, d):
    """Chunks in a database: stored, French ones stored again, one source deleted, and
    the ten nearest to a vector found by scanning."""
    path = f"{shared_folder(s)}/notes.db"
    kept = database.DatabaseStore(s, functools.partial(sqlite3.connect, path, timeout=60), "notes", 26, "sqlite")
    kept.ensure()
    rows = embed.embed_chunks(_units(s, d), embed.letter_frequency)
    kept.store(rows.withColumn("metadata", F.parse_json(F.to_json(F.struct("lang")))))
    kept.store(rows.where("lang = 'fr'").withColumn("text", F.concat(F.lit("again "), F.col("text"))).withColumn("metadata", F.parse_json(F.lit("{}"))))
    kept.delete_documents([r["source_doc_id"] for r in rows.where("source = 'src3'").select("source_doc_id").collect()])
    return kept.chunks().select("unit_id", F.sha2("text", 256).alias("text_sha256"), F.try_variant_get("metadata", "$.lang", "string").alias("lang"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("letters"))


# stores and units


def _small(s, d) -> DataFrame:
    return chunk.fixed(_documents(s, d), 2048, 0).select("unit_id", "source_doc_id", F.octet_length("data").alias("n_bytes"))


def upsert(s, d):
    """Chunks of a store, then those of French documents again, cut smaller."""
    new = chunk.fixed(_documents(s, d).where("lang = 'fr'"), 1024, 0).select("unit_id", "source_doc_id", F.octet_length("data").alias("n_bytes"))
    return store.upsert(_small(s, d), new)


def delete_docs(s, d):
    gone = _documents(s, d).where("source in ('src3', 'src5')").select(F.col("document_id").alias("source_doc_id"))
    return store.delete(_small(s, d), gone, "source_doc_id")


def unit_envelope(s, d):
    """Facts and chunks wrapped, and read back."""
    facts = _facts(s, d)
    wrapped = facts.select(serde.wrap(serde.FACT, facts.columns).alias("e"))
    back = wrapped.select(F.col("e.type").alias("unit_type"), serde.unwrap(F.col("e"), serde.FACT).alias("u"))
    chunks = _units(s, d).select("unit_id", "source_doc_id", "source_uri", "text")
    wrapped = chunks.select(serde.wrap(serde.CHUNK, chunks.columns).alias("e"))
    more = wrapped.select(F.col("e.type").alias("unit_type"), serde.unwrap(F.col("e"), serde.CHUNK).alias("u"))
    return back.select("unit_type", F.col("u.id").alias("unit_id"), F.col("u.subject").alias("said")).unionByName(more.select("unit_type", F.col("u.id").alias("unit_id"), F.sha2("u.text", 256).alias("said")))


NAMES = (
    doc_fingerprint, doc_construct, doc_changed_anti, token_count, token_count_approx, bm25_tokens, parse_score,
    chunk_fixed, chunk_fixed_overlap, chunk_sentence, chunk_sentence_overlap, chunk_recursive, chunk_recursive_overlap, chunk_semantic, chunk_late, chunk_contextual, chunk_proposition,
    bm25_tf, bm25_df, bm25_stats, bm25_topk, bm25_filtered, bm25_repeated_terms,
    knn_batch, knn_filtered, knn_topk, filter_eq, filter_in, filter_any_of, filter_all, filter_missing, filter_events,
    vector_letters, hybrid_rrf, ensemble, router, graph_match, fact_text, small_to_big, structured_sql, structured_units, web_results,
    litm_reorder, crossencoder, auth_post, auth_pre, auth_roles, auth_tenant, eval_precision_recall, eval_context, eval_judged, upsert, delete_docs, unit_envelope,
    score_history, auth_grants, auth_everything, vector_codec, metadata_codec, filter_translations, chunk_tables, web_search,
    pipeline_ingest, pipeline_tenants, pipeline_subjects, stream_ingest, database_store,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in queries()} | {"structured_sql": TPCH_LIKE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of documents for all benchmark items."""
    return hybrid_rrf(spark, sf_dir)
