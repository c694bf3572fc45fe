import hashlib
import math
from collections import Counter

import pytest

from ordertide.llm import mixing, op1


def brute_count(seed, doc_id, mean):
    parts = max(1, math.ceil(mean / mixing.PART_MEAN))
    m, n = mean / parts, 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-m)
        k = 0
        while c <= u and k < m + 12 * math.sqrt(m) + 30:
            k += 1
            p *= m / k
            c += p
            n += 1
    return n


SCHEMA = "doc_id long, text string, source string, copy string"


def rows(n=400):
    return [(i, "t" * (i % 7), ["hot", "a", "b", None][0 if i % 3 else 1 + i % 4 % 3], "x") for i in range(n)] + [(None, None, "a", None), (0, "", "hot", None), (0, "", "hot", None)]


def expected(data, weights, total, seed):
    n = Counter(r[2] for r in data)
    weights = {s: 1.0 for s in n} if weights is None else {s: weights.get(s, 0.0) for s in n}
    total = len(data) if total is None else total
    out = Counter()
    for d, _, s, _ in data:
        mean = total * weights[s] / (sum(weights.values()) * n[s])
        for k in range(1, brute_count(seed, d, mean) + 1):
            out[d, s, k] += 1
    return out


@pytest.mark.parametrize("weights,total", [(None, None), ({"hot": 3.0, "a": 1.0, None: 2.0}, 900), ({"a": 1.0}, 60_000), ({"zzz": 1.0}, None)])
@pytest.mark.parametrize("broadcast", [100, 0])
def test_against_brute_force(spark, monkeypatch, weights, total, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    data = rows()
    weights_ = weights
    if weights == {"zzz": 1.0}:
        want = Counter()
    else:
        want = expected(data, weights_, total, "s")
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), weights, total, "s").collect()
    assert Counter((r.doc_id, r.source, r.copy) for r in got) == want


def test_shares_and_order(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) AS source")
    out = mixing.mix(df, seed="q")
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(v / 4000 - 1) < 0.08 for v in n.values()) and len(n) == 5
    places = [[r.place for r in part] for part in out.rdd.glom().collect()]
    assert all(p == sorted(p) for p in places)
    assert mixing.mix(df.limit(0)).count() == 0
    assert out.exceptAll(mixing.mix(df.repartition(13), seed="q")).count() == 0


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op1.query(spark, sf)
    want = con.sql(op1.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)


def test_rows_without_an_id_are_spread(spark):
    df = spark.createDataFrame([(None, f"t{i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing.mix(df.unionByName(spark.createDataFrame([(1, "x", "s")], df.schema)), total=6000)
        sizes = [len(p) for p in out.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) > 2000 and max(sizes) < 0.6 * sum(sizes)
