"""The registered queries: their columns, and their SQL where there is some."""

import pytest
from oracle import check, connect

from quillstone.llm import mixing, quality, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got, want = check(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_a_document_or_more(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_native_operators_run_no_python(spark, monkeypatch):
    """What stands before the cuts, which a query's own plan doesn't show."""
    monkeypatch.setattr(mixing, "cut", lambda df: df)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plans = [quality.features(docs).withColumns(quality.votes()), mixing.mixture(docs), mixing.mix(docs)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "ExistingRDD" not in plan
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
