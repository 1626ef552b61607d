"""Evaluation of retrieval, and of answers made from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .retrieve import Retriever


def relevance(cases: DataFrame) -> DataFrame:
    """Rows (case_id, document_id) of the cases' relevant documents, repeats too."""
    return cases.select("case_id", F.explode("relevant_document_ids").alias("document_id"))


def measured(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """What the units of each case amount to, in one pass over them.

    Rows (case_id, context_precision, context_recall, context) of all cases that
    have units or relevant documents. Precision is the share of units that are of
    relevant documents, recall the share of relevant documents (repeats counted)
    that units are of; both are null without relevant documents, and 0 without
    units. The context is the units' texts by rank, with a blank line between.
    """
    listed = relevant.groupBy("case_id", F.col("document_id").alias("source_doc_id")).agg(F.count("*").alias("times"))
    total = listed.groupBy("case_id").agg(F.sum("times").alias("asked"))
    units = found.select(F.col("query_id").alias("case_id"), "rank", "source_doc_id", "as_text").join(listed, ["case_id", "source_doc_id"], "left")
    # a case has at most as many units as it wants
    per = units.groupBy("case_id").agg(
        F.count("times").alias("hits"), F.count("*").alias("n"), F.collect_set(F.when(F.col("times").isNotNull(), F.struct("source_doc_id", "times"))).alias("docs"), F.collect_list(F.struct("rank", "as_text")).alias("texts")
    )
    both = per.join(total, "case_id", "full")
    right = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["times"])
    return both.select(
        "case_id",
        F.when(F.col("asked") > 0, F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))).alias("context_precision"),
        F.when(F.col("asked") > 0, F.coalesce(right / F.col("asked"), F.lit(0.0))).alias("context_recall"),
        _context("texts").alias("context"),
    )


def _context(texts: str) -> Column:
    return F.array_join(F.transform(F.array_sort(texts), lambda u: u["as_text"]), "\n\n")


def context_precision(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Precision alone, of all cases."""
    return cases.select("case_id").join(measured(found, relevance(cases)), "case_id", "left").select("case_id", "context_precision")


def context_recall(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Recall alone, of all cases."""
    return cases.select("case_id").join(measured(found, relevance(cases)), "case_id", "left").select("case_id", "context_recall")


def contexts(found: DataFrame) -> DataFrame:
    """The texts of each query's units by rank, with a blank line between."""
    return found.groupBy(F.col("query_id").alias("case_id")).agg(F.collect_list(F.struct("rank", "as_text")).alias("texts")).select("case_id", _context("texts").alias("context"))


def evaluate(
    cases: DataFrame,
    retriever: Retriever,
    top_k: int = 10,
    generate: Callable[[Column, Column], Column] | None = None,
    judge: Callable[[Column], Column] | None = None,
    relevant: DataFrame | None = None,
) -> DataFrame:
    """Metrics of all cases (case_id, question, reference_answer, relevant_document_ids).

    Retrieval is planned once. Where relevant documents are many, ``relevant`` has
    them as rows (case_id, document_id) instead of arrays.
    ``generate`` makes an answer of question and context, ``judge`` answers a
    prompt; both are expressions or pandas UDFs, and faithfulness and relevance
    need both of them. What was not asked for is null.
    """
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"), F.lit(top_k).alias("top_k"))
    told = measured(retriever(queries), relevance(cases) if relevant is None else relevant)
    out = cases.join(told, "case_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    nothing = F.lit(None).cast("string")
    out = out.withColumn("answer", generate(F.col("question"), F.col("context")) if generate else nothing)
    for kind in ("faithfulness", "relevance"):
        prompt = expr.judge_prompt(kind, F.col("question"), F.col("context"), F.col("answer"))
        out = out.withColumn(kind, expr.parse_score(judge(prompt)) if generate and judge else F.lit(None).cast("double"))
    return out
