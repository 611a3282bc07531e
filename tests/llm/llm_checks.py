"""Compare a query's rows with those of its DuckDB SQL."""

import duckdb

SF_SMALL = "/root/testdata/sf0.001"


def compare(result, sql, tables=None):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        path = (tables or {}).get(name, f"{SF_SMALL}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    columns = sorted(result.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in result.select(*columns).collect()]
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(got, key=key) == sorted(expected, key=key)
