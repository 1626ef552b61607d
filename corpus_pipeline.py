"""A training corpus from raw documents: filter, deduplicate, mask, mix, tokenise."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import quality as q
from corvane.llm.byte_bpe import Codec, byte_bpe
from corvane.llm.common import settle, stash, table, tune, whole_text
from corvane.llm.mixing import mixed_texts
from corvane.llm.ngram_join import ngram_join
from corvane.llm.pii import find_pii, masked


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them, does not reject.

    Null and empty texts have no faults and stay; repeated rows are judged alike;
    long texts whole; an empty table stays empty.
    """
    tune(spark)
    found = q.seen(docs, rows=True)
    return q.keep_good(found, q.fit(found))


def _free(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "_new"
    while name in docs.columns:
        name += "_"
    return name


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Rows with a null id all stay. Of rows that repeat an id, one stays.
    """
    told, of = stash(ngram_join(docs), "told"), _free(docs)
    same = F.col("doc_id") == F.col(of)
    # what goes grows with the corpus, so it is merged at every size and never broadcast
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias(of)).distinct()
    left = docs.join(gone.hint("merge"), same, "left_anti")
    repeated = stash(told.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(of)).count().where("count > 1").select(of), "repeated")
    if repeated.isEmpty():
        return left
    # rows of an id are reduced before they are sent
    again = left.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(whole_text()), whole_text())).alias("row")).select("row.*")
    return left.join(repeated, same, "left_anti").unionByName(again)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind.

    Texts without spans, null ones too, and all other columns stay as they are.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found, row, some = find_pii(rows, carry=("row",)), F.col("row"), F.size("spans") > 0
    masks = found.withColumn("masked", F.when(some, masked(row["text"], F.col("spans"))).otherwise(row["text"]))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length("masked").cast("long")).otherwise(row["n_chars"])
    return masks.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Documents without words, and null texts, are never taken.
    """
    return mixed_texts(docs, docs.columns)


def _numbers(codec: Codec, ids: list[int]) -> dict:
    return {"n_tokens": len(ids), "ids": ids, "decoded": codec.decode(ids).decode("utf-8", "replace")}


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them.

    A null text has no tokens and decodes to an empty one.
    """
    return byte_bpe(docs, finish=_numbers, returns=("n_tokens long, ids array<int>, decoded string", [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", masked_documents),
    ("mixing sources", mixed_documents),
    ("byte-level BPE", tokenised),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next;
    what a stage wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, partial(stage, spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
