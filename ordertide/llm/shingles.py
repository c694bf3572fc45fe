"""Word shingles of texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one numpy step (which takes about 40 times that), and in one batch handed to the
#: operators (which take about 20 times that, and as much again for what they return).
SLICE_BYTES, BATCH_BYTES = 1 << 18, 1 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((_LOWER + 1).astype(np.uint64))
_BYTE[~_WORD] = 0
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slice_words(data: np.ndarray, forced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of `data`; places in `forced` begin a new text."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[forced] = inside[forced]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    parts = _BYTE[data[starts[0] :]] * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(parts, starts - starts[0])), starts


_CASED = mix(np.arange(1, 257, dtype=np.uint64))


def slice_tokens(data: np.ndarray, forced: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (letters as they are) and start of every run of bytes of one kind but 0; places in
    `forced` begin a new text."""
    kinds = kind[data]
    first = kinds > 0
    first[1:] &= kinds[1:] != kinds[:-1]
    forced = forced[forced < len(data)]
    first[forced] = kinds[forced] > 0
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    parts = np.where(kinds[starts[0] :] > 0, _CASED[data[starts[0] :]], np.uint64(0)) * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(parts, starts - starts[0])), starts


def small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about BATCH_BYTES of the text in `column`, or of one longer text."""
    for batch in batches:
        _, at = text_buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def slices(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of about SLICE_BYTES that begin and end with a text; a text longer
    than that is cut between words, at places that depend on nothing but itself."""
    begin, last = int(at[0]), int(at[-1])
    while begin < last:
        end = min(last, begin + SLICE_BYTES)
        if end < last:
            j = int(np.searchsorted(at, end, "right")) - 1
            if at[j] > begin:
                end = int(at[j])
            else:
                while end < at[j + 1]:
                    gap = np.flatnonzero(~_WORD[data[end : end + 4096]])
                    if len(gap):
                        end = min(int(at[j + 1]), end + int(gap[0]))
                        break
                    end = min(int(at[j + 1]), end + 4096)
        yield begin, end
        begin = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text), texts lying at `at` in `data`."""
    hashes, starts = [], []
    for begin, end in slices(data, at):
        own = at[np.searchsorted(at, begin) : np.searchsorted(at, end)] - begin
        h, s = slice_words(data[begin:end], own)
        hashes.append(h)
        starts.append(s + begin)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def _sequence(words_: np.ndarray) -> np.ndarray:
    """Hash of each row's words in their order."""
    acc = mix(words_[:, 0])
    for k in range(1, words_.shape[1]):
        acc = mix(acc * np.uint64(_BASE) + words_[:, k])
    return acc


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (uint64); of the whole
    sequence where it has fewer words; nothing where it has none."""
    data, at = text_buffers(column)
    h, before = words(data, at)
    if len(h) >= k:
        acc = mix(h[: len(h) - k + 1])
        for j in range(1, k):
            acc = mix(acc * np.uint64(_BASE) + h[j : len(h) - k + 1 + j])
    else:
        acc = np.zeros(0, np.uint64)
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= k:
            yield np.unique(acc[a : b - k + 1])
        elif b > a:
            yield _sequence(h[None, a:b]) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
