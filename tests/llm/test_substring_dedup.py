import hashlib
import random

import numpy as np
import pytest
import xxhash

from ordertide.llm import op6, suffixes
from ordertide.llm import substring_dedup as sd


def marked(text):
    """As Spark's xxhash64 has it."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, seed=42)).view(np.int64))


def brute(rows, length):
    """(id, n_bytes, n_removed, n_spans, sha256 of the rest) for each row."""
    texts = {(i is None, i or 0, marked((t or "").encode())): (t or "").encode() for i, t in rows}
    seen, spans = set(), {}
    for key in sorted(texts):
        b = texts[key]
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans[key] = gone
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = spans[i is None, i or 0, marked(b)]
        rest = bytes(c for c, g in zip(b, gone) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé\x00") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(80))
    rows = []
    for _ in range(n):
        kind, text = rng.random(), " ".join(word() for _ in range(rng.randrange(60)))
        if kind < 0.3 and rows:
            text = rng.choice(rows)[1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "X"]) + text[at:]
        elif kind < 0.6:
            a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
            text = text + passage[a:b] + text
        elif kind < 0.7:
            text = rng.choice(["ab", "was ", "é"]) * rng.randrange(90)
        rows.append((rng.randrange(1000), text))
    return rows + [(None, passage), (None, passage + "!"), (3, None), (4, ""), rows[0], (5, passage), (5, passage + "?"), (5, passage)]


def rows_of(df):
    from pyspark.sql import functions as F

    got = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("seed,length,shard,chunk", [(1, 100, 1 << 20, 2 << 20), (2, 30, 200, 300), (3, 10, 64, 100), (4, 100, 300, 150), (5, 5, 1 << 20, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, length, shard, chunk):
    """Tasks run in this process' forks only if workers are new, so sizes are set where they are read."""
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    assert rows_of(sd.dedup(df, length)) == brute(rows, length)
    # the same by the parts alone, with small pieces and shards
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "CHUNK_BYTES", chunk)
    import pyarrow as pa

    class Held:  # with these seeds anchors are whole, or frequent ones of a level
        value = [np.full(sd.BITMAP_BITS // 8, 255, np.uint8)] * (1 + (seed - 1) % 5)

    marks = [marked((t or "").encode()) for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows]), pa.array(marks)], names=["id", "text", "mark"])
    cut = [r for b in sd._segment_rows(length, Held)(iter([batch])) for r in b.to_pylist()]
    cut.sort(key=lambda r: (r["part"], r["id"] is None, r["id"] or 0, r["mark"], r["at"]))
    rows_in = pa.RecordBatch.from_pylist(cut, pa.schema([("part", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())]))
    gone = {}
    for b in sd._intervals(length)(iter([rows_in])):
        for r in b.to_pylist():
            gone.setdefault((r["id"], r["mark"]), set()).update(range(r["from"], r["to"]))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        g = gone.get((i, marked(raw)), set())
        out.append((i, len(raw), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(c for k, c in enumerate(raw) if k not in g)).hexdigest()))
    assert sorted(out, key=str) == brute(rows, length)


def test_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0)
    rows = corpus(9)
    assert rows_of(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20)) == brute(rows, 20)


def test_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "FREQUENT", (1, 5, 20, 60))
    rows = corpus(12)
    base = " ".join(f"b{j}" for j in range(90))
    rng = random.Random(5)
    for i in range(90):  # variants of a text, and null ids among them
        at = rng.randrange(len(base))
        rows.append((2000 + i if i % 3 else None, base[:at] + rng.choice("xyzé") + base[at + 1 :]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(sd.dedup(df)) == brute(rows, 100)
    assert rows_of(sd.dedup(df, 30)) == brute(rows, 30)


@pytest.mark.parametrize("length", [5, 30, 100])
def test_blocks_hold_every_window_once(length):
    rng = np.random.default_rng(length)
    span = length - min(sd.GRAM, length) + 1
    lead = rng.integers(0, span, 200)
    windows = np.array([rng.integers(1, x + 2) for x in lead])
    assert sd.block_sizes(length)[-1] == 1
    for size in [0, *sd.block_sizes(length)]:
        of, skip, count, number = sd.blocks(windows, lead, np.full(200, size))
        for k in range(200):
            mine = [(a, n, b) for o, a, n, b in zip(of, skip, count, number) if o == k]
            assert [w for a, n, _ in mine for w in range(a, a + n)] == list(range(windows[k]))
            assert not size or all((lead[k] - w) // size == b for a, n, b in mine for w in range(a, a + n))


def test_lists_instead_of_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(sd, "BITMAP_ANCHORS", 0)
    rows = corpus(11)
    assert rows_of(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40)) == brute(rows, 40)
    assert rows_of(sd.dedup(spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string"))) == brute([(1, "a" * 300)], 100)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(200):
        codes = rng.integers(0, rng.integers(2, 5), rng.integers(0, 60)).astype(np.uint16)
        depth = int(rng.integers(1, 40))
        text = codes.tolist()
        order = suffixes.suffix_array(codes, depth).tolist()
        assert order == sorted(range(len(text)), key=lambda i: (text[i : i + depth], i))

        def lcp(a, b):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k] and text[a + k]:
                k += 1
            return k

        want = [0] * min(1, len(text)) + [lcp(a, b) for a, b in zip(order, order[1:])]
        assert suffixes.common_prefixes(codes, np.array(order, np.int64)).tolist() == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op6.query(spark, sf).collect()), key=str)
    assert got == brute(rows, 100) and any(r[2] for r in got)


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
