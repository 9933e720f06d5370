"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path


def rows(df):
    df = df[sorted(df.columns)]

    def text(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        if x is None or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(map(tuple, df.map(text).values.tolist()))


def expected(sql, sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con.execute(sql).fetchdf()


def same(spark, queries, sqls, name, sf):
    got, want = queries[name](spark, sf).toPandas(), expected(sqls[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert not any(isinstance(v, float) and math.isinf(v) for v in got.select_dtypes("number").values.ravel()[:1000])
