"""Rows of a query and of its SQL as sorted text, for tests."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    want = want.astype({c: "float64" for c in want.columns if str(want[c].dtype) == "Int64"})  # as Spark gives whole numbers with nulls
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [sorted(map(tuple, x[names].astype(object).where(x[names].notna(), None).map(str).values.tolist())) for x in (got, want)]
    assert len(rows[0]) and rows[0] == rows[1]
