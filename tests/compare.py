"""A query's rows against those of its DuckDB SQL."""

import duckdb

from lumenfold.plans import catalog


def compared(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got
