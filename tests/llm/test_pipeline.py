import base64
import importlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_mixing import brute_count
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_substring_dedup import brute as brute_spans
from ordertide.llm import substring_dedup as sd

pipeline = importlib.import_module("corpus_pipeline")


def brute(rows, labels):
    """(doc_id, text, source, n_tokens, ids) of every row of the result."""
    stay = {i for i, *_ in brute_quality([r[:2] for r in rows], labels, strata=[r[3] for r in rows])}
    rows = [r[:3] for r in rows if r[0] in stay]
    first = {i: c for i, _, c in brute_groups([(i, t) for i, t, _ in rows], 5, 8, 10)}
    rows = [r for r in rows if first[r[0]] == r[0]]
    seen, left = set(), []
    for i, t, s in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        rest = bytes(c for c, g in zip(b, gone) if not g)
        if rest or not b:
            left.append((i, rest.decode(errors="ignore"), s))
    sizes = {s: sum(r[2] == s for r in left) for s in {r[2] for r in left}}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(pipeline.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, s in left:
        ids = enc.encode_ordinary(t)
        out += [(i, t, s, len(ids), tuple(ids))] * brute_count("mix", i, len(left) / (len(sizes) * sizes[s]))
    return sorted(out)


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = sorted((r.doc_id, r.text, r.source, r.n_tokens, tuple(np.frombuffer(bytes(r.token_ids), "<u4").tolist())) for r in pipeline.run(spark, sf).collect())
    want = brute(rows, labels)
    assert [g[:4] for g in got] == [w[:4] for w in want] and got == want
    assert brute_spans([(1, "x")], 100)


def test_stages_on_odd_rows(spark, tmp_path):
    long = "One two three four five six seven eight nine ten eleven twelve. " * 3000
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, long, "a", 5), (3, long, "a", 5), (4, long + "end", "b", 5), (None, "No id here at all.", "b", 5), (5, "éé漢" * 80, "b", 1), (6, "xé" + "éé漢" * 80, "b", 1), (7, "tiny", "a", 4)]
    schema = "doc_id long, text string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:4] == docs.columns and (k == 4 or out.columns == docs.columns)
            path = f"{tmp_path}/{len(data)}-{k}"
            out.write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if k == 0:
                assert docs.count() == len(data)
            elif k == 1 and data:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 3, 5, 6, 7]
            elif k == 2 and data:
                assert all(r.n_chars == len(r.text) for r in docs.collect()) and before.count() - docs.count() <= 1
        assert data or docs.count() == 0


def test_repeated_ids_of_different_texts_stay(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, text("a"), "x"), (2, text("a") + " end", "x"), (2, text("b"), "x"), (2, text("c"), "z"), (2, text("c"), "y"), (2, text("c") + " end", "x"), (3, "", "x"), (3, "", "w"), (None, text("a"), "x")]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    want = [(1, text("a"), "x"), (2, text("b"), "x"), (2, text("c"), "y"), (3, "", "w"), (None, text("a"), "x")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clashing_columns_pass_through(spark, tmp_path):
    names = ["weight", "key", "copy", "place", "cdf", "parts", "node", "id", "kept", "n_bytes", "decoded", "ids_le", "good", "label", "spans", "_id", "shingle", "fingerprint"]
    docs = spark.createDataFrame([(i, f"Text number {i} is here. " * 9, "s", *(f"{n}{i}" for n in names)) for i in range(5)], ["doc_id", "text", "source", *names])
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names) and docs.count()


def test_pieces_of_characters_go(spark):
    """Removed bytes may begin or end inside a character, of which then nothing is left."""
    df = spark.createDataFrame([(1, "x" + "éàü" * 40), (2, "y" + "éàü" * 40 + "é"), (3, "\u00a9" + "éàü" * 40), (4, ""), (5, None), (6, "éàü" * 40)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.dedup_text(df, 100).collect()}
    assert got[1] == "x" + "éàü" * 16 + "éà"[:2] or got[1].startswith("xéà")
    assert got[4] == "" and not got[5] and 6 not in got and got[3][0] == "©"
    assert all("\ufffd" not in (t or "") for t in got.values())


def test_damaged_round_trip_fails(spark, monkeypatch):
    real = pipeline.bpe.round_trip
    monkeypatch.setattr(pipeline.bpe, "round_trip", lambda *a, **k: real(*a, **k).withColumn("_decoded", F.encode(F.lit("z"), "UTF-8")))
    with pytest.raises(Exception, match="don't decode"):
        pipeline.encode_texts(spark, spark.createDataFrame([("a",)], "text string"), "").collect()
