"""Every registered check with an oracle: Spark result equals DuckDB's on
the same parquet tables (rows, column names and types, values)."""

import pytest

from quarry.plans.registry import load_all
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck_conn

CHECKS = load_all()
WITH_SQL = sorted(n for n, c in CHECKS.items() if c.sql)


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, con, name):
    c = CHECKS[name]
    res = compare(spark, con, name, c.fn, c.sql, SF_SMALL)
    assert res["status"] == "ok", res


def test_every_check_runs_rows_only(spark):
    for n, c in CHECKS.items():
        if c.sql is None:
            assert c.fn(spark, SF_SMALL).count() > 0, n


def test_sentence_packing_sql_tight_limits(spark, con):
    """The packing SQL and the Spark fold agree where overlaps are frequent."""
    from quarry.operators.chunk import sentence_chunks
    from quarry.plans.catalog_text import _sentence_chunks_sql
    from quarry.plans.registry import Tables
    sdf = sentence_chunks(Tables(spark, SF_SMALL).documents, limit=128, overlap=30)
    res = compare(spark, con, "sentence_chunks_128_30", lambda s, sf: sdf,
                  _sentence_chunks_sql(limit=128, overlap=30), SF_SMALL)
    assert res["status"] == "ok" and res["spark_rows"] > 400, res
