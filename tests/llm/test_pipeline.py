from __future__ import annotations

from pathlib import Path

import corpus_pipeline as p
from corvane.llm import queries

from .helpers import empty, odd

DATA = "/root/testdata/sf0.001"


def test_stages_return_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(len(counts))))
        docs = spark.read.parquet(str(tmp_path / str(len(counts))))
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    rows = p.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted(r.decoded for r in rows) == sorted(r.text for r in docs.collect())


def test_near_copies_leave_one(spark):
    docs = odd(spark)
    left = p.one_of_each_group(spark, docs, "")
    rows = left.collect()
    ids = [r.doc_id for r in rows]
    assert left.columns == docs.columns
    assert ids.count(0) == 1 and 1 not in ids and ids.count(8) == 1 and 9 not in ids and ids.count(None) == 2


def test_odd_and_empty_tables(spark):
    for make in (odd, empty):
        docs = make(spark)
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        p.STAGES[-1][1](spark, docs, "").collect()


def test_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "1 AS `a b`", "'x' AS `row`", "array(2) AS `c:d,e`")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_run(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    rows = p.run(spark, DATA).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert len(set(shared.iterdir()) - before) == len(p.STAGES) - 1  # what the stages returned


def test_registered():
    assert sorted(k.split("_")[0] for k in queries.queries() if k.startswith("op")) == sorted(f"op{n}" for n in range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
