import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ordertide.llm import ngram_join, op2, shingles
from ordertide.llm.components import components


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and len(x & y) * den >= len(x | y) * num:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgjklmnp" for b in ("a", "Ér", "o", "UN", "é")]
    word = lambda: rng.choice(vocabulary)
    line = " ".join(word() for _ in range(12))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45:  # one large group of near copies
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.6 and rows:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.6:
                text += " " + word()
        elif kind < 0.7:
            text = " ".join(word() for _ in range(rng.randrange(5)))
        else:
            text = line + " " + " ".join(word() for _ in range(rng.randrange(3, 90)))
        rows.append((rng.randrange(10**6), text))
    return rows + [(None, " ".join(base)), (5, None), (6, ""), (7, " \t\r\n"), (8, "x"), (9, "X"), (10, "x\x00y\xa0z"), rows[3]]


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 90, 100), (2, 5, 8, 10), (3, 1, 7, 10), (4, 3, 90, 100)])
def test_against_all_pairs(spark, monkeypatch, seed, k, num, den):
    if seed == 4:  # few common shingles known, and no broadcast
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", 2)
        monkeypatch.setattr(ngram_join, "RUN_SHINGLES", 500)
        monkeypatch.setattr(ngram_join, "COMMON_MOST", 300)
        monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    out = ngram_join.join(df, k, num, den)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, k, num, den)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op2.query(spark, sf).collect()), key=str)
    assert got == brute(rows, 3, 90, 100) and any(c != i for i, _, c in got)


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "other words are in this one"
    rows = [(5, a), (5, b), (3, a), (4, b), (9, c), (9, ""), (9, None), (7, c), (8, ""), (8, None), (None, a), (6, a), (6, c)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (6, 3), (6, 3), (7, 3), (8, 8), (8, 8), (9, 3), (9, 3), (9, 3)]


def test_long_lists_are_counted_in_shares(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 2)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    src = docs.select("text")
    number, census = ngram_join.Numbers(), ngram_join.map_arrow(docs, ngram_join._census(3, 64), ngram_join._CENSUS)
    common = spark.sparkContext.broadcast(ngram_join._common(census))
    listed = []
    for entries in (10**9, 5):
        monkeypatch.setattr(ngram_join, "LIST_ENTRIES", entries)
        lists = ngram_join.map_arrow(src, ngram_join._prefixes(3, 90, 100, common, number), "shingle long, node long, place int, n int, share int")
        assert lists.agg({"share": "max"}).first()[0] == 0 if entries == 10**9 else lists.select("share").distinct().count() > 5
        listed.append(sorted(tuple(r) for r in ngram_join._listed(lists)[0].select("shingle", "node", "place", "n", "times").collect()))
    assert listed[0] == listed[1] and len(listed[0]) > 100
    assert sorted((tuple(r) for r in ngram_join.join(docs, 3, 90, 100).collect()), key=str) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("bits", [2, 64])
def test_sets_that_share_a_hash_stay_apart(spark, bits):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)]
    rows += [(100 + i, t + " end") for i, t in rows[::2]] + [(200 + i, t) for i, t in rows[::3]]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, hash_bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 3, 8, 10)


@pytest.mark.parametrize("share", [0, 1000])
def test_dear_and_cheap_nodes(spark, monkeypatch, share):
    monkeypatch.setattr(ngram_join, "CHEAP_SHARE", share)
    rng = random.Random(share)
    rows = []
    for g in range(3):  # variants of a text, near the similarity and under it
        base = [f"{g}w{j}" for j in range(150)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: rng.choice([150, 150, 140, 120])])))
    got = sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10).collect()), key=str)
    assert got == brute(rows, 5, 8, 10) and len({r[2] for r in got}) > 20


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = ["", "ab  cd\tEF", None, "word " * 3000 + "z" * 9000 + " end", "x", "p" * 5000, "a b c d e f"]
    whole = [x.tolist() for x in shingles.sets(pa.array(texts), 3)]
    monkeypatch.setattr(shingles, "SLICE_BYTES", 64)
    assert [x.tolist() for x in shingles.sets(pa.array(texts), 3)] == whole
    assert [len(x) for x in whole] == [len(shingle_set(t, 3)) for t in texts]
    assert [x.tolist() for x in shingles.sets(pa.array(["q", *texts]).slice(1), 3)] == whole


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}
    assert np.all([v <= k for k, v in got.items()])
