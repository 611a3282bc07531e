"""Every registered query against its DuckDB oracle SQL on the smallest driver data."""

import pytest

import __spark_entry__ as E
from checks.compare import rows_of
from tests.conftest import SF_SMALL

from quillstone.plans.catalog import QUERIES  # noqa: E402  (tests/llm holds the others)
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def test_every_query_has_oracle_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows, True) == rows_of(d_cols, d_rows, True)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["anomaly_type", "severity", "count"]
    assert {r.anomaly_type for r in rows} == {
        "HIGH_AMOUNT", "INVALID_ACCOUNT", "NEGATIVE_BALANCE", "DUPLICATE", "RAPID_TRANSACTIONS", "LOCATION_MISMATCH"}


def _spark_type_name(dt):
    from pyspark.sql import types as T
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
             T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP"}
    return names.get(type(dt), dt.simpleString())


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_query_types_match_oracle(spark, duck, key):
    """Column types agree (no session-zone timestamps, decimals or wide integers leak out)."""
    sdf = QUERIES[key](spark, SF_SMALL)
    s_types = {f.name: _spark_type_name(f.dataType) for f in sdf.schema.fields}
    rel = duck.sql(SQL[key])
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert s_types == d_types
