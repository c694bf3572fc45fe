"""Byte-level BPE by monoid tree reduction.

A text is halved recursively. A leaf is encoded by itself; two neighbours are
joined by encoding once more only a window around their common boundary. The
window grows on either side until it ends at a *seam*, and tokens outside the
two seams are then proven final:

* A seam is a place between a letter or digit and a character that is white
  space, punctuation, or (for ASCII) of the other of these two classes. Every
  alternative of the splitting pattern matches characters of one class only,
  with at most one leading space (or the apostrophe of a contraction), so no
  match crosses a seam, whatever stands before or behind it.
* Matches up to a seam never look past it (contractions end in letters, and
  the look-ahead of white-space runs stops at the run's next character), and
  matches after a seam never look back. So encoding distributes over a cut at a
  seam: encode(x + y) == encode(x) + encode(y).

Hence left = A + a, right = b + B with seams between, and
encode(left + right) = encode(A) + encode(a + b) + encode(B): the tokens of a
and b are dropped from the two sides and those of a + b are put between. With
no seam in a side the window covers that side whole, which is always right.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import map_arrow

LEAF_CHARS = 512
FIRST_WINDOW = 16
#: Rows handed on at a time.
BATCH_ROWS = 1000

_SEAM = re.compile(r"[^\W_](?=[ \t\n\r!-/:-@\[-`{-~。，、；：！？])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def first_seam(text: str) -> int | None:
    """The first seam after at least one character, looked for in growing windows."""
    window = FIRST_WINDOW
    while True:
        found = _SEAM.search(text, 0, min(window, len(text)))
        if found:
            return found.end()
        if window >= len(text):
            return None
        window *= 4


def last_seam(text: str) -> int | None:
    """The last seam of the text, looked for in growing windows at its end."""
    window = FIRST_WINDOW
    while True:
        start = max(0, len(text) - window)
        last = None
        for last in _SEAM.finditer(text, start):
            pass
        if last is not None:
            return last.end()
        if not start:
            return None
        window *= 4


class Codec:
    """Encoder and decoder for one rank file; `leaf_chars` is the size at which halving stops."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leaf_chars = max(1, leaf_chars)

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of left + right from those of both."""
        if not left or not right:
            return left_ids + right_ids
        cut, resume = last_seam(left), first_seam(right)
        before = left[cut:] if cut else left
        after = right[:resume] if resume else right
        n_before = len(self._leaf(before)) if cut else len(left_ids)
        n_after = len(self._leaf(after)) if resume else len(right_ids)
        return left_ids[: len(left_ids) - n_before] + self._leaf(before + after) + right_ids[n_after:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids) -> bytes:
        """Bytes of the ids, concatenated up the tree; an id that the ranks lack raises KeyError."""
        if len(ids) <= self.leaf_chars:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf_chars: int) -> Codec:
    """One codec per Python worker; the rank file is read where the task runs."""
    return Codec(ranks_path, pattern, leaf_chars)


def _small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _with_columns(df: DataFrame, source: str, names: list[str], of) -> DataFrame:
    """`df` plus binary columns made from `source` in Arrow batches; columns of those names are
    replaced. One Python worker makes all of them."""
    kept = [c for c in df.columns if c not in names]
    where = df.columns.index(source)
    places = [df.columns.index(c) for c in kept]
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of()
        for batch in _small(batches):
            made = list(zip(*(make(v.as_py()) for v in batch.column(where)), strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *(pa.array(m, pa.binary()) for m in made)], names=[*kept, *names])

    return map_arrow(df, apply, schema)


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids_le", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """Add `ids`: the token ids of `text` as little-endian unsigned 32-bit integers.

    Null text counts as empty and gives empty bytes. Rows are independent: repeated
    rows, ties and any other columns pass through; a column named `ids` is replaced.
    The rank file must be readable at `ranks_path` on every executor.
    """

    def of():
        encode = codec(ranks_path, pattern, leaf_chars).encode
        return lambda v: (_packed(encode(v or "")),)

    return _with_columns(df, text, [ids], of)


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _unpacked(ids: bytes | None) -> list[int]:
    return np.frombuffer(ids or b"", "<u4").tolist()


def decode_documents(
    df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids_le", out: str = "decoded", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """Add `out`: the bytes that the ids in `ids` stand for. Null ids count as none."""

    def of():
        decode = codec(ranks_path, pattern, leaf_chars).decode
        return lambda v: (decode(_unpacked(v)),)

    return _with_columns(df, ids, [out], of)


def round_trip(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids_le", out: str = "decoded", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """encode_documents() and decode_documents() of its ids, in one pass of the same workers."""

    def of():
        c = codec(ranks_path, pattern, leaf_chars)

        def make(v: str | None) -> tuple[bytes, bytes]:
            packed = _packed(c.encode(v or ""))
            return packed, c.decode(_unpacked(packed))

        return make

    return _with_columns(df, text, [ids, out], of)


def token_counts(df: DataFrame, ids: str = "ids_le", name: str = "n_tokens") -> DataFrame:
    return df.withColumn(name, (F.octet_length(ids) / 4).cast("long"))
