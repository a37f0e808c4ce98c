"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from paperloom.operators import lookup
from paperloom.queries.compare import canonical, connect
from paperloom.queries.registry import QUERIES

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    found = QUERIES[name].run(spark, SMALL).toPandas()
    if QUERIES[name].sql is None:
        assert len(found) > 0
        return
    expected = connection.execute(QUERIES[name].sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)


SALTED = (
    "crawl_papers pdf_plan metadata_waterfall metadata_services assign_category classify_papers enrich_dedup "
    "translate_column qa_answers"
).split()


@pytest.mark.parametrize("name", SALTED)
def test_query_with_every_repeated_key_salted(spark, connection, monkeypatch, name):
    hot_keys = lookup.hot_keys
    monkeypatch.setattr(lookup, "hot_keys", lambda counts, share, min_rows: hot_keys(counts, 1e-3, 1))
    found = QUERIES[name].run(spark, SMALL).toPandas()
    assert canonical(found) == canonical(connection.execute(QUERIES[name].sql).df())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 50
    assert set(entry_module.oracle_sql()) < set(entry_module.queries())
