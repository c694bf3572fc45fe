"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


#: Names of the same types.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def canon(v):
    return float(v) if isinstance(v, float) else v


def same(spark_df, con, sql: str) -> None:
    """The same columns and the same rows, in any order."""
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns), (spark_df.columns, rel.columns)
    cols = sorted(rel.columns)
    mine_types, their_types = dict(spark_df.dtypes), dict(zip(rel.columns, map(str, rel.types)))
    for c in cols:
        assert TYPES.get(their_types[c], mine_types[c]) == mine_types[c], (c, mine_types[c], their_types[c])
    mine = sorted((tuple(map(canon, r)) for r in spark_df.select(*cols).collect()), key=str)
    theirs = sorted((tuple(map(canon, r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
