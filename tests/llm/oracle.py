"""Holds a query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sf_dir, sql, names):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    at = [x[0] for x in got.description]
    assert sorted(at) == sorted(names)
    return sorted((tuple(r[at.index(n)] for n in names) for r in got.fetchall()), key=str)


def check(df, sf_dir, sql):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(sf_dir, sql, df.columns)
    assert len(got) == len(want)
    assert got == want
