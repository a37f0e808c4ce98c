"""The registered queries against their SQL, and the pipeline, on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from paperloom.llm import queries
from paperloom.queries.compare import canonical, connect

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SMALL).toPandas()
    expected = connect(SMALL).execute(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and canonical(found) == canonical(expected)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before.columns, name
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
