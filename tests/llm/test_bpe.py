import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ordertide.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "   x", "a  b", "don't we'll they've I'd'd", "'" * 9, "x\n\n\n y\t\tz ", "naïve—café 漢字。仮名 １２３4a5b", "a" * 3000, "_a_.b_" * 50, "\x1c\x85   z", "é" * 40, "🙂👩‍👩‍👧 " * 9]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODECS = [bpe.Codec(RANKS, P.PATTERN, leaf) for leaf in (1, 3, 16)]


def test_odd_texts(library):
    for text in ODD + [" ".join(ODD)]:
        for codec in CODECS:
            ids = codec.encode(text)
            assert ids == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab1 '\n\t.,_slted漢é  -²")), max_size=60))
def test_any_text(text):
    from functools import reduce

    whole = bpe.codec(RANKS, P.PATTERN, 10_000).encode(text)
    for codec in CODECS:
        assert codec.encode(text) == whole
    # any bracketing gives the same ids: joining is associative
    parts = [text[i : i + 7] for i in range(0, len(text), 7)] or [""]
    c = CODECS[0]
    _, ids = reduce(lambda a, b: (a[0] + b[0], c.join(a[0], a[1], b[0], b[1])), [(p, c.encode(p)) for p in parts])
    assert ids == whole


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, None])]
    rng = random.Random(4)
    rows.append((99, "".join(rng.choice("ab c.1") for _ in range(200_000)), "long"))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_le string")
    out = bpe.token_counts(bpe.decode_documents(bpe.encode_documents(df, RANKS, P.PATTERN, leaf_chars=32), RANKS, P.PATTERN)).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(bytes(r.ids_le), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    both = bpe.token_counts(bpe.round_trip(df, RANKS, P.PATTERN, leaf_chars=32)).collect()
    key = lambda r: (r.doc_id, r.n_tokens, bytes(r.ids_le), bytes(r.decoded))
    assert sorted(map(key, both)) == sorted(map(key, out))
    assert bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark, library):
    from ordertide.llm import op10

    sf = "/root/testdata/sf0.001"
    want = {
        (r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
        for ids in [library.encode_ordinary(r.text or "")]
    }
    assert {tuple(r) for r in op10.query(spark, sf).collect()} == want
