"""Compare a query with its DuckDB statement: row count, types and values, whatever the order of rows."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v != v:
        return "null"
    return repr(v.item() if hasattr(v, "item") else v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(df, sql, c):
    got = [tuple(r) for r in df.collect()]
    c.execute(sql)
    names = [x[0] for x in c.description]
    want = c.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
