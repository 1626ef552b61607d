"""Retrievers: a table of queries becomes a ranked table of units.

Queries have ``query_id``, ``text``, ``top_k`` and what a retriever needs besides.
Units have the columns UNITS; ``rank`` counts from 1 within a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import SCORES, MetadataFilter
from ..sources.store import DEFAULT_TOP_K

UNITS = ("query_id", "rank", "unit_type", "unit_id", "source_doc_id", "source_uri", "as_text", "score", "scores", "parent_id")
#: Queries that one broadcast holds; more are taken in several rounds.
QUERY_BLOCK = 4096
#: Words of queries that a broadcast holds; more are joined by shuffles.
ASKED_ROWS = 200_000
#: Chunks that are multiplied with a block of queries at once.
ROW_BLOCK = 1024
K1, B, RRF_K = 1.2, 0.75, 60


class Retriever(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame: ...


def wanted(top_k: Column | str = "top_k") -> Column:
    """How many results a query wants."""
    k = F.col(top_k) if isinstance(top_k, str) else top_k
    return F.when(F.coalesce(k, F.lit(0)) <= 0, DEFAULT_TOP_K).otherwise(k)


def queries_from(df: DataFrame, query_id: str, text: str, top_k: int = 0, **more: str) -> DataFrame:
    """Rows of ``df`` as queries."""
    return df.select(F.col(query_id).cast("string").alias("query_id"), F.col(text).alias("text"), F.lit(top_k).alias("top_k"), *[F.col(c).alias(k) for k, c in more.items()])


def best(scored: DataFrame, limit: Column, *order: Column) -> DataFrame:
    """Ranked rows of each query, as many as it wants; ties go by ``unit_id``. Spark
    cuts each partition's rows before it shuffles them."""
    by = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"),)), "unit_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def units(ranked: DataFrame, unit_type: str = "chunk", stage: str | None = None) -> DataFrame:
    """Ranked rows in the form that all retrievers return."""
    have = set(ranked.columns)
    get = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    scores = get("scores", SCORES)
    text = F.col("as_text") if "as_text" in have else expr.as_text("text", get("window_text", "string"), get("context_prefix", "string"))
    return ranked.select(
        "query_id", F.col("rank").cast("int").alias("rank"), (F.col("unit_type") if "unit_type" in have else F.lit(unit_type)).alias("unit_type"), "unit_id",
        get("source_doc_id", "string").alias("source_doc_id"), get("source_uri", "string").alias("source_uri"), text.alias("as_text"),
        F.col("score").cast("double").alias("score"), (expr.with_score(scores, stage, F.col("score")) if stage else scores).alias("scores"), get("parent_id", "string").alias("parent_id"),
    )


def _rounds(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on blocks of queries that are small enough to broadcast."""
    rounds = max(1, -(-queries.count() // QUERY_BLOCK))
    if rounds == 1:
        return run(queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    return reduce(DataFrame.unionByName, (run(queries.where(block == i)) for i in range(rounds)))


def _prefer(chunks: DataFrame, filters: Sequence[MetadataFilter], tenants: bool) -> DataFrame:
    return chunks.where(expr.match_all(filters, chunks.columns)) if filters else chunks


# vectors


def _nearest(asked: list, digits: int | None, tenants: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows of a partition for each query, as a function of its Arrow batches.

    Rows come in blocks that are multiplied with all queries of their length at once;
    of each query only as many rows as it wants are held.
    """
    ids = [q["query_id"] for q in asked]
    limits = [q["_limit"] for q in asked]
    lengths = np.array([len(q["_query"]) for q in asked])
    owners = np.array([q["_tenant"] or "" for q in asked]) if tenants else None
    groups = []
    for size in sorted(set(lengths.tolist()) - {0}):
        who = np.flatnonzero(lengths == size)
        x = np.array([asked[i]["_query"] for i in who], dtype=np.float64)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        groups.append((who, size, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)))

    def scores(vectors: list) -> np.ndarray:
        out = np.zeros((len(ids), len(vectors)))
        for who, size, x in groups:
            fit = [i for i, v in enumerate(vectors) if len(v) == size]
            if fit:
                y = np.array([vectors[i] for i in fit], dtype=np.float64)
                norm = np.sqrt((y * y).sum(1, keepdims=True))
                out[np.ix_(who, fit)] = x @ np.divide(y, norm, out=np.zeros_like(y), where=norm > 0).T
        return np.round(out, digits) + 0.0 if digits else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, str]]] = [[] for _ in ids]
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                units_, vectors = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                got = scores(list(vectors))
                if tenants:
                    theirs = np.array([t or "" for t in part.column(2).to_pylist()])
                    got[(owners[:, None] != "") & (owners[:, None] != theirs[None, :])] = -np.inf
                for i, row in enumerate(got):
                    k, mine = limits[i], held[i]
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    if len(mine) == k:
                        least = max(least, -mine[-1][0])
                    new = np.flatnonzero((row >= least) & (row > -np.inf))
                    if len(new):
                        held[i] = sorted(mine + [(-row[j], units_[j]) for j in new])[:k]
        rows = [(q, u, -s) for q, mine in zip(ids, held) for s, u in mine]
        yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(("query_id", "unit_id", "score"))}, schema=pa.schema([("query_id", pa.string()), ("unit_id", pa.string()), ("score", pa.float64())]))

    return run


def vector(chunks: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | None = None, filters: Sequence[MetadataFilter] = (), digits: int | None = None) -> DataFrame:
    """The nearest chunks by cosine, exactly.

    Queries have a ``vector``, or get one of their text by ``embed``. All filters
    hold before scoring. If both sides have a ``tenant_id``, a query with one sees
    only that tenant's chunks. Vectors of other lengths and zero vectors score 0.

    Queries are taken in blocks of at most QUERY_BLOCK. Each block travels to the
    executors, where the chunks are multiplied with it as they are scanned; a
    partition passes on only as many rows of a query as it wants, so the shuffle
    does not grow with the chunks' size. ``digits`` rounds scores before they are
    compared.
    """
    if embed is not None and "vector" not in queries.columns:
        queries = queries.withColumn("vector", embed(F.col("text")))
    rows = _prefer(chunks, filters, True).where("vector is not null")
    tenants = "tenant_id" in queries.columns and "tenant_id" in rows.columns
    slim = rows.select(F.col("unit_id").cast("string").alias("unit_id"), "vector", *(["tenant_id"] if tenants else []))
    owner = F.col("tenant_id") if tenants else F.lit(None).cast("string")
    asked = queries.where("vector is not null").select("query_id", wanted().alias("_limit"), F.col("vector").cast("array<double>").alias("_query"), owner.alias("_tenant"))

    def run(block: DataFrame) -> DataFrame:
        return slim.mapInArrow(_nearest(block.collect(), digits, tenants), "query_id string, unit_id string, score double")

    near = _rounds(asked, run).join(_limits(queries), F.col("query_id") == F.col("_asked"))
    ranked = best(near, F.col("_limit")).select("query_id", "unit_id", "rank", "score")
    payload = rows.drop("vector", "norm").withColumn("unit_id", F.col("unit_id").cast("string"))
    return units(ranked.join(payload, "unit_id"), stage="vector")


# words


def _counted(words: DataFrame) -> DataFrame:
    """Postings of rows (unit_id, length, term)."""
    return words.groupBy("term", "unit_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


@dataclass
class Bm25Index:
    """Words of chunks, or stored postings (term, unit_id, tf, length) and documents of
    each term; totals of all chunks; and the chunks that may be found."""

    words: DataFrame | None
    stored: tuple[DataFrame, DataFrame] | None
    totals: DataFrame
    chunks: DataFrame
    #: Whether ``chunks`` are fewer than those that the statistics cover.
    limited: bool = False

    @classmethod
    def build(cls, chunks: DataFrame) -> "Bm25Index":
        """Of chunks with unique ids; statistics cover all of them, also those
        without words. Nothing is computed yet."""
        if "as_text" not in chunks.columns:
            have = set(chunks.columns)
            get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
            chunks = chunks.withColumn("as_text", expr.as_text("text", get("window_text"), get("context_prefix")))
        sized = chunks.select("unit_id", expr.tokens("as_text").alias("words")).select("unit_id", F.size("words").alias("length"), "words")
        # an outer explode, as an inner one would test the words' number by splitting again
        words = sized.select("unit_id", "length", F.explode_outer("words").alias("term")).where("term is not null")
        return cls(words, None, sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), chunks)

    @property
    def postings(self) -> DataFrame:
        return self.stored[0] if self.stored else _counted(self.words)

    @property
    def terms(self) -> DataFrame:
        return self.stored[1] if self.stored else self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def of(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and document counts of the terms in ``asked`` alone: other words
        are dropped where they are read, before anything is shuffled."""
        if self.stored:
            return self.stored[0].join(asked, "term", "left_semi"), self.stored[1]
        some = _counted(self.words.join(asked, "term", "left_semi"))
        return some, some.groupBy("term").agg(F.count("*").alias("df"))

    def within(self, chunks: DataFrame) -> "Bm25Index":
        """The same statistics, with fewer chunks to be found."""
        return Bm25Index(self.words, self.stored, self.totals, self.chunks.join(chunks.select("unit_id"), "unit_id", "left_semi"), True)

    def write(self, path: str) -> "Bm25Index":
        """Keep the index as Parquet, postings clustered by term, and read it back."""
        spark = self.chunks.sparkSession
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        kept = spark.read.parquet(f"{path}/postings")
        kept.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")
        return Bm25Index(None, (kept, spark.read.parquet(f"{path}/terms")), spark.read.parquet(f"{path}/totals"), self.chunks)


def bm25(index: Bm25Index, queries: DataFrame, filters: Sequence[MetadataFilter] = (), k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """The best chunks by BM25; a term that a query repeats counts again.

    Only postings of the queries' terms are joined; the queries' words are counted
    first, and travel to the postings if they are few enough. Filters (and tenants, as for
    vectors) remove candidates and leave the statistics alone. Only positive
    scores stay.
    """
    asked = queries.select("query_id", F.explode(expr.tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    postings, terms = index.of(asked.select("term").distinct())
    if asked.count() <= ASKED_ROWS:
        # postings by chunk meet all words of all queries where they are: what they make is summed without a shuffle
        found = postings.repartition("unit_id").join(F.broadcast(asked.join(terms, "term")), "term")
    else:
        found = postings.join(asked, "term").join(terms, "term")
    rows = _prefer(index.chunks, filters, True)
    if filters or index.limited or ("tenant_id" in queries.columns and "tenant_id" in rows.columns):
        found = found.join(rows.select("unit_id", *(["tenant_id"] if "tenant_id" in rows.columns else [])), "unit_id")
    totals = found.crossJoin(F.broadcast(index.totals))  # one row
    n, df, tf = F.col("n").cast("double"), F.col("df").cast("double"), F.col("tf").cast("double")
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    part = idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("length") / F.col("mean"))) * F.col("times")
    keys = ["query_id", "unit_id"]
    wants = queries.select(F.col("query_id").alias("_asked"), wanted().alias("_limit"), *([F.col("tenant_id").alias("_tenant")] if "tenant_id" in queries.columns else []))
    total = F.sum("part")
    summed = totals.withColumn("part", part).groupBy(*keys, *(["tenant_id"] if "tenant_id" in totals.columns else [])).agg((F.round(total, digits) if digits else total).alias("score")).where("score > 0")
    limited = summed.join(wants, F.col("query_id") == F.col("_asked"))
    if "_tenant" in limited.columns and "tenant_id" in limited.columns:
        limited = limited.where(F.coalesce(F.col("_tenant"), F.lit("")).isin("") | (F.col("_tenant") == F.col("tenant_id")))
    ranked = best(limited, F.col("_limit")).select("query_id", "unit_id", "rank", "score")
    return units(ranked.join(index.chunks, "unit_id"), stage="bm25")


# fusion


def _stacked(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (r.withColumn("_list", F.lit(i)) for i, r in enumerate(results)))


def _limits(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").alias("_asked"), wanted().alias("_limit"))


def hybrid(queries: DataFrame, results: Sequence[DataFrame], k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists that have a
    unit, which keeps the history of the first such list."""
    k = k if k > 0 else RRF_K
    rest = [c for c in UNITS if c not in ("query_id", "unit_id", "rank", "score")]
    total = F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank")))
    fused = _stacked(results).groupBy("query_id", "unit_id").agg((F.round(total, digits) if digits else total).alias("score"), F.min(F.struct("_list", "rank", *rest)).alias("first"))
    rows = fused.select("query_id", "unit_id", "score", *[F.col(f"first.{c}").alias(c) for c in rest])
    return units(best(rows.join(_limits(queries), F.col("query_id") == F.col("_asked")), F.col("_limit")), stage="rrf_fusion")


def ensemble(queries: DataFrame, results: Sequence[DataFrame]) -> DataFrame:
    """All lists together; of a unit in several, its first occurrence; by own score."""
    first = Window.partitionBy("query_id", "unit_id").orderBy("_list", "rank")
    rows = _stacked(results).withColumn("_first", F.row_number().over(first)).where("_first = 1")
    return units(best(rows.join(_limits(queries), F.col("query_id") == F.col("_asked")), F.col("_limit")), stage="ensemble")


@dataclass
class Route:
    name: str
    retriever: Retriever
    match: Callable[[Column], Column]


def router(queries: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Each query goes to the first route that matches its text, or nowhere."""
    number = F.lit(None).cast("int")
    for i in reversed(range(len(routes))):
        number = F.when(F.coalesce(routes[i].match(F.col("text")), F.lit(False)), i).otherwise(number)
    routed = queries.withColumn("_route", number)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (r.retriever(routed.where(F.col("_route") == i).drop("_route")) for i, r in enumerate(routes)))


# facts


def graph(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """Facts, with unique ids, by the share of a query's words that occur in "subject
    predicate object", as words or within words.

    Words have no blanks, so a query's word occurs in a fact if it occurs in one of
    the fact's words. Of the facts' different words, all parts that are as long as
    some query's word are matched with the queries' different words by equality.
    """
    asked = queries.select("query_id", wanted().alias("_limit"), expr.tokens("text").alias("_terms")).where(F.size("_terms") > 0)
    terms = asked.select("query_id", "_limit", F.size("_terms").alias("_n"), F.explode("_terms").alias("_term")).groupBy("query_id", "_limit", "_n", "_term").agg(F.count("*").alias("_times"))
    said = facts.select("unit_id", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "subject", "predicate", "object")), expr.BLANKS))).alias("_word")).where("_word <> ''")
    known = terms.select("_term").distinct()
    # a row a length of a word; words are few letters long
    lengths = known.select(F.length("_term").alias("_length")).distinct().agg(F.collect_set("_length").alias("_lengths"))
    words = said.select("_word").distinct().crossJoin(F.broadcast(lengths)).select("_word", F.explode("_lengths").alias("_length")).where(F.col("_length") <= F.length("_word"))
    parts = words.select("_word", "_length", F.explode(F.sequence(F.lit(1), F.length("_word") - F.col("_length") + 1)).alias("_at"))
    within = parts.select("_word", F.substring("_word", F.col("_at"), F.col("_length")).alias("_term")).join(known, "_term", "left_semi").distinct()
    hits = said.join(within, "_word").select("unit_id", "_term").distinct().join(terms, "_term")
    scored = hits.groupBy("query_id", "_limit", "unit_id").agg((F.sum("_times").cast("double") / F.first("_n")).alias("score"))
    ranked = best(scored, F.col("_limit")).select("query_id", "unit_id", "rank", "score")
    return units(ranked.join(facts.withColumn("as_text", expr.fact_text()), "unit_id"), unit_type="graph_fact", stage="graph")


def small_to_big(found: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks replaced by their parents; a parent stands where its first child stood
    and has its best child's score. Units without a known parent pass through."""
    big = parents.select(F.col("unit_id").alias("_id"), F.col("source_doc_id").alias("_doc"), (F.col("source_uri") if "source_uri" in parents.columns else F.lit(None).cast("string")).alias("_uri"), F.col("text").alias("_text"))
    joined = found.join(big, (found["parent_id"] == big["_id"]) & (found["unit_type"] == "chunk"), "left")
    own = F.struct(*[c for c in UNITS if c not in ("query_id", "rank", "score")])
    key = F.when(F.col("_id").isNotNull(), F.concat(F.lit("p"), F.col("_id"))).otherwise(F.concat(F.lit("u"), F.col("rank").cast("string")))
    grouped = joined.groupBy("query_id", key.alias("_key")).agg(F.min("rank").alias("at"), F.max("score").alias("score"), F.min_by(F.struct("_id", "_doc", "_uri", "_text", own.alias("own")), "rank").alias("row"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    there = F.col("row._id").isNotNull()
    pick = lambda big, own: F.when(there, F.col(f"row.{big}")).otherwise(F.col(f"row.own.{own}")).alias(own)
    new = expr.with_score(F.lit(None).cast(SCORES), "small_to_big", F.col("score"))
    return grouped.select(
        "query_id", rank.cast("int").alias("rank"), F.col("row.own.unit_type").alias("unit_type"), pick("_id", "unit_id"), pick("_doc", "source_doc_id"), pick("_uri", "source_uri"), pick("_text", "as_text"),
        "score", F.when(there, new).otherwise(F.col("row.own.scores")).alias("scores"), F.when(~there, F.col("row.own.parent_id")).alias("parent_id"),
    )


# other sources


def structured(spark: SparkSession, query_id: str, text: str, text_to_sql: Callable[[str], str], source_doc_id: str, args: dict | None = None) -> DataFrame:
    """Rows of a query written in SQL, in its order, each with score 1; ids count from 0."""
    rows = spark.sql(text_to_sql(text), args=args or {})
    columns = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    # ids grow along the partitions, which follow the query's order: within a
    # partition they count, and the sizes of the partitions before are added
    ordered = rows.select(columns.alias("columns"), F.monotonically_increasing_id().alias("_at"))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    ranked = ordered.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.col("_before") + within + 1).select(F.lit(query_id).alias("query_id"), "rank", F.concat(F.lit("row-"), (F.col("rank") - 1).cast("string")).alias("unit_id"), F.lit(source_doc_id).alias("source_doc_id"), expr.row_text("columns").alias("as_text"), F.lit(1.0).alias("score"))
    return units(ranked, unit_type="structured_row", stage="structured")


def web(queries: DataFrame, search: Callable[[str, int], Sequence[tuple[str, str, str]]]) -> DataFrame:
    """Results (url, title, snippet) of an external search, in its order; the score
    falls by 0.01 a place. The search runs on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, i, url, title, snippet) for q, text, k in zip(frame.query_id, frame.text, frame.k) for i, (url, title, snippet) in enumerate(search(text, int(k)))]
            yield pd.DataFrame(rows, columns=["query_id", "at", "url", "title", "snippet"])

    found = queries.select("query_id", "text", wanted().alias("k")).mapInPandas(run, "query_id string, at int, url string, title string, snippet string")
    return web_units(found)


def web_units(found: DataFrame) -> DataFrame:
    """Search results (query_id, at from 0, url, title, snippet) as units."""
    score = F.lit(1.0) - F.col("at") * F.lit(0.01)
    ranked = found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("url").alias("unit_id"), F.lit("web").alias("source_doc_id"), F.col("url").alias("source_uri"), F.col("snippet").alias("as_text"), score.alias("score"))
    return units(ranked, stage="web")
