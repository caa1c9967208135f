"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb


def views(data):
    db = duckdb.connect()
    for name in os.listdir(data):
        path = f"{data}/{name}"
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def same(query, sql, spark, data):
    df = query(spark, data)
    got = table(df.columns, df.collect())
    result = views(data).sql(sql)
    expected = table(result.columns, result.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1]
