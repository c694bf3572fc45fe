import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from ordertide.llm import op8, quality, shingles

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def grams(text):
    """The n-grams' buckets, one by one."""
    tokens, before = [], None
    for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+", (text or "").encode()):
        h = mix(sum(mix(c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w)) & M)
        tokens.append(1 if h == before else h)
        before = h
    pairs = [(a * 0x9E3779B97F4A7C15 + b) & M for a, b in zip(tokens, tokens[1:])]
    return [mix(x) >> 52 for x in tokens + pairs]


TEXTS = ["", None, "a", "ab", "The cat sat sat SAT on 9 mats!!", "é漢字 漢字 x", "word " * 4000, "A\tB\nC  ", "the the", "the the the the the the the the the the the the the the the", "x!! x!! !!", "end"]


@pytest.mark.parametrize("size", [4 << 20, 40])
def test_grams(monkeypatch, size):
    monkeypatch.setattr(shingles, "SLICE_BYTES", size)
    data, at = shingles.text_buffers(pa.array(TEXTS))
    got = [Counter() for _ in TEXTS]
    for buckets, texts, froms, tos in quality.grams(data, at):
        for t, a, b in zip(texts, froms, tos):
            got[t].update(buckets[a:b].tolist())
    for g, t in zip(got, TEXTS):
        assert g == Counter(grams(t)), t


def brute(rows, labels, seed="quality", strata=None):
    strata = strata or [None] * len(rows)
    raw, good, of = Counter(), Counter(), {s: Counter() for s in strata}
    for (i, t), s in zip(rows, strata):
        raw.update(grams(t))
        of[s].update(grams(t))
        if labels.get(i) == 1:
            good.update(grams(t))
    ratio, less = {}, dict.fromkeys(of, 0)
    if good:
        n, m, a = sum(raw.values()), sum(good.values()), quality.PSEUDO * quality.BUCKETS
        ratio = {k: (good[k] + a * r / n) / ((m + a) * r / n) for k, r in raw.items()}
        less = {s: round(math.log(sum(r * ratio[k] for k, r in c.items()) / sum(c.values())) * quality.UNIT) if c else 0 for s, c in of.items()}
    out = []
    for (i, t), s in zip(rows, strata):
        u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52 + 2.0**-53
        w = sum(round(math.log(ratio[g]) * quality.UNIT) - less[s] for g in grams(t)) if good else 0
        out.append((i, w, w - round(math.log(-math.log(u)) * quality.UNIT)))
    if not good:
        return sorted(out, key=str)
    k = sum(w >= -quality.EVIDENCE * quality.UNIT for _, w, _ in out)
    least = sorted((key for *_, key in out), reverse=True)[k - 1] if k else math.inf
    return sorted((r for r in out if r[2] >= least), key=str)


def run(spark, rows, labels, strata=None):
    docs = spark.createDataFrame([(i, t, "x", s) for (i, t), s in zip(rows, strata or [None] * len(rows))], "doc_id long, text string, weight string, stratum string").repartition(3)
    kept = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), stratum="stratum" if strata else None)
    return sorted(((r.doc_id, r.weight, r.key) for r in kept.collect()), key=str)


def close(got, want):
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(abs(a[1] - b[1]) <= 9000 and abs(a[2] - b[2]) <= 9000 for a, b in zip(got, want))  # logarithms may differ in the last bit


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "PSEUDO", 1e-3)
    rows = [(i, f"The {w} was here, and it went away again.") for i, w in enumerate("cat dog cow hen fox owl bee ant".split())]
    rows += [(50 + i, f"{w}$$$ the### {w}%%% of&&& {w}***") for i, w in enumerate("cat dog cow hen".split())]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)] + [rows[0], (None, "Null id here."), (None, None)]
    labels = [(0, 1), (1, 1), (2, 1), (3, 1), (50, 0), (51, 0), (None, 1), (4, None), (999, 1)]
    close(run(spark, rows, labels), brute(rows, {i: q for i, q in labels if i is not None and q is not None}))
    some = brute(rows, {0: 1, 1: 1, 2: 1, 3: 1})
    assert 0 < len(some) < len(rows)
    strata = ["a" if i % 3 else None for i in range(len(rows))]
    known = {0: 1, 1: 1, 5: 1, 50: 0}
    close(run(spark, rows, list(known.items()), strata), brute(rows, known, strata=strata))
    close(run(spark, rows, []), brute(rows, {}))
    close(run(spark, rows, labels[:2]), brute(rows, {0: 1, 1: 1}))
    assert run(spark, [], labels) == []


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "SELECT_CLASSES", 7)
    values = [5, 5, 5, -10**15, 10**15, 0, -3, 4, 10**15 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, the other half is judged."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 2 = 0"), stratum="lang").collect()}
    judged = labels.where("doc_id % 2 = 1").collect()
    wrong = [r.doc_id for r in judged if (r.doc_id in kept) != (r.quality == 1)]
    assert len(wrong) <= 0.01 * len(judged) and {r.quality for r in judged} == {0, 1}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in op8.query(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    wrong = [r for r in labels if (r.doc_id in kept) != (r.quality == 1)]
    assert len(wrong) <= 0.01 * len(labels)
