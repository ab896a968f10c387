"""The pipeline, stage by stage, and the registered queries' SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from chronoframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(got[cols].astype(str).values.tolist()) == sorted(want[cols].astype(str).values.tolist())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        seen.append(now.count())
    assert seen[0] >= seen[1] > seen[2] == seen[3]
    packed = corpus_pipeline.STAGES[3][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == seen[3]


def test_edges(spark):
    text = "mail a.b@c.de " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 5), (2, text, "en", "s", 5), (None, text, None, None, None), (3, None, None, None, None), (4, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        got = now.collect()
        assert len(got) == (4 if given is docs else 0)
