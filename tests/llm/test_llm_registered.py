"""The corpus queries: against SQL where there is some, and the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from monthloom.llm.oracles import ORACLES
from monthloom.llm.registered import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_all_are_registered():
    numbers = sorted(int(q.split("_")[0][2:]) for q in QUERIES)
    assert numbers == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_values_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got) == sorted(want)
    got, want = (f[sorted(got)].sort_values(sorted(got)).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) > 0 and got.dtypes.tolist() == want.dtypes.tolist()
    assert (got.isna() == want.isna()).all(axis=None)
    assert got.astype(str).where(got.notna(), "").equals(want.astype(str).where(want.notna(), ""))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns and kept * 0.5 < docs.count() <= kept, name
        kept = docs.count()
    assert docs.where("text rlike '[0-9a-f]{16}'").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert pieces.groupBy("doc_id").sum("length").count() == kept
