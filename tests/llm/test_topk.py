import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.llm import op4, topk


def brute(rows, asks, k, scale=1024):
    good = [(i, [math.floor(scale * x) if abs(x) < 2**60 else scale * int(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, longest = [], 2**63 - 1
    for q in sorted({i for i, _ in good if asks(i)}):
        scored = sorted((-max(-longest - 1, min(longest, sum(a * b for a, b in zip(x, v)))), i) for p, x in good if p == q for i, v in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows_of(df):
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, df.collect()))


def vectors(seed, n, d):
    rng = random.Random(seed)
    rows = [(3 * i, [rng.choice([-1, 1]) * rng.random() ** 4 for _ in range(d)]) for i in range(n)]
    same = rows[5][1]
    rows += [(10_000 + i, same) for i in range(40)]  # one common vector
    return rows


@pytest.mark.parametrize("c,q,d", [(8192, 1024, 40), (16, 4, 40), (16, 4, 3)])
def test_against_all_pairs(spark, monkeypatch, c, q, d):
    monkeypatch.setattr(topk, "CANDIDATES", c)
    monkeypatch.setattr(topk, "QUERIES", q)
    monkeypatch.setattr(topk, "QUERY_BYTES", q * 400)
    monkeypatch.setattr(topk, "LEAST_CANDIDATES", q)
    rows = vectors(d, 150, d)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert rows_of(topk.top_k(df, F.col("vec_id") % 15 == 0, 7)) == brute(rows, lambda i: i % 15 == 0, 7)


def test_odd_rows(spark):
    rows = [(0, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1e6, -3e8, 7.0]), (7, [0.001]), (None, [1.0, 1.0]), (8, [-0.0005, 2.0]), (8, [-0.0005, 2.0]), (8, [-0.0005, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, F.lit(True), 3)) == brute(rows, lambda i: True, 3)
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 3, 9, 15, 17]) for _ in range(3)]) for i in range(30)] + [(90, [1e306, 0.0, 0.0]), (91, [-1e307, 1.0, 1.0]), (92, [1e17] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, F.col("vec_id") % 5 == 0, 40)) == brute(rows, lambda i: i % 5 == 0, 40)


@pytest.mark.parametrize("known", [False, True])
def test_bounds_drop_candidates(known):
    rng = np.random.default_rng(1)
    rows = np.floor(1024 * rng.normal(size=(4000, 64)) * np.linspace(0.01, 2, 64))
    ids = np.arange(4000)
    block = topk.Block(rows, ids)
    mine, partial = block.starts(rows[:5])
    for q in range(5):
        want = sorted((-s, i) for i, s in enumerate(rows @ rows[q]) if i != q)[:10]
        left = block.best(mine[q], partial[q], q, 10, -want[-1][0] if known else None)
        assert len(left[0]) < 2000
        got = topk.first_k(*left, 10)
        assert list(zip(-got[1], got[0])) == want


def test_query_and_sql(spark):
    import duckdb

    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
        assert rows_of(op4.query(spark, f"/root/testdata/{sf}")) == sorted(con.sql(op4.SQL).fetchall())


def test_repeated_ids_as_in_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 7, 7, 100, 200, i]), [rng.random() for _ in range(4)]) for i in range(1, 90)]
    rows += [(5, [2.0] * 4)] * 14 + [(100, [0.5] * 4)] * 3 + [(300, [1.0, 2.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows_of(op4.query(spark, str(tmp_path))) == sorted(con.sql(op4.SQL).fetchall())
