"""Holds a Spark result against the rows that DuckDB gives for the query's SQL."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Integers, floats (nine digits), strings and None compare alike on both sides; other kinds by their text."""
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return f"{type(v).__name__} {v}"


def duck(sql: str, sf: str, documents: str | None = None):
    """Sorted names and counted rows of a statement over the tables of sf; documents may name other files for that table."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    if documents:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{documents}')")
    for t in TABLES:
        if not (documents and t == "documents") and Path(f"{DATA}/{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def hold(df, sql: str, sf: str) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    (a, left), (b, right) = spark_rows(df), duck(sql, sf)
    assert a == b
    assert left == right, f"only in Spark {list((left - right).items())[:3]}, only in SQL {list((right - left).items())[:3]}; rows {sum(left.values())}, {sum(right.values())}"
    return sum(left.values())
