"""Runs a named query and its SQL over the same small tables."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    return v


def both(spark, query, sql, sf=SF):
    """Rows of the query and of the SQL, columns sorted by name."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()]
    return sorted(map(repr, ours)), sorted(map(repr, theirs))
