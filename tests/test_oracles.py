import pytest

from quillon import catalog
from tests.oracle import compare

DIR = "/root/testdata/sf0.01"

@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], DIR)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, DIR).collect()
    assert rows
    if name == "default_findings":
        texts = {r.doc_id: r.text for r in catalog.documents(spark, DIR).collect()}
        assert all(texts[r.doc_id][r.start_char : r.end_char] == r.text for r in rows)
