"""Removal of repeated byte strings by suffix arrays over content-addressed shards.

Each window of `length` bytes has an anchor: its 24-gram of least hash, the leftmost of
equal ones. Equal windows have equal anchors, so windows are dealt to shards by their
anchor and never need to be compared across anchors. Neighbouring windows of one anchor
form a segment, which is what moves. Equal windows also lie equally around their anchor; so
an anchor that occurs very often is dealt by more than itself: its windows are taken in
blocks of neighbouring places around it, and a block goes to the shard of the bytes that all
its windows share. The more often it occurs, the smaller the blocks, down to single windows;
variants of a text then meet only where they differ in less than a block. Three steps:

1. Census: hashes of all anchors are counted; those seen twice or more go into a bitmap of
   fixed size, or where they are too many into lists by text. Windows of other anchors occur
   once and stay where they are. Small bitmaps tell the frequent anchors; where one errs, an
   anchor is dealt in smaller blocks than it need be, the same everywhere.
2. Segments of repeated anchors are cut from the texts. A task sends equal segments once
   and settles later ones itself, so that a passage shared by very many documents reaches
   its shard at most a few times per task.
3. In a shard, segments of an anchor in the order of the documents: an equal segment before
   settles one whole; else segments are joined to one text, its suffix array is made by
   Larsson-Sadakane refinement, common prefixes by Kasai, and windows with a common
   prefix of `length` are equal. An anchor with more segments than fit a shard is worked on
   shard by shard, each shard's windows found in the sorted ones before by binary search.

The results are intervals of bytes, which meet their texts again by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .store import map_arrow, materialise
from .suffixes import first_equal

LENGTH = 100
GRAM = 24
#: Bytes of text worked on at a time, and of segments in one suffix array.
CHUNK_BYTES, SHARD_BYTES = 1 << 19, 1 << 19
#: Bits of the bitmap of repeated anchors, and up to how many of these it is used: it then lets
#: about one in 80 other segments move. Beyond, exact lists of anchors are joined to the texts.
BITMAP_BITS, BITMAP_ANCHORS = 1 << 27, 8 << 20
#: Occurrences beyond which an anchor's windows are dealt in blocks, of a third of the size each time
#: (the last: one window), and the bits of each bitmap that tells these anchors.
FREQUENT, FREQUENT_BITS = (1_000, 30_000, 1_000_000, 30_000_000), 1 << 24
#: Segments that a task remembers, to send equal ones once; beyond, it starts anew and sends some again.
KNOWN_SEGMENTS = 250_000
#: Size of the intervals' table up to which it is broadcast to the texts (16 bytes an interval and 64 a
#: text); a shuffle join beyond.
BROADCAST_BYTES = 64 << 20

_SEGMENT = "part long, id long, mark long, at long, windows int, bytes binary"


def chunks(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, begin, end) of pieces of about CHUNK_BYTES. A longer text is cut
    into pieces that overlap by length - 1 bytes, so that each window lies in one piece."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        begin, end = int(at[i]), int(at[j])
        if end - begin <= 2 * CHUNK_BYTES:
            yield i, j, begin, end
        else:
            for b in range(begin, end - length + 1, CHUNK_BYTES):
                yield i, j, b, min(end, b + CHUNK_BYTES + length - 1)
        i = j


def segments(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor's hash, anchor's place after start) of the segments of `data`, in which
    texts end at `edges`."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64), none
    gram = min(GRAM, length)
    eight = data.astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes from each place, zeros past the end
        eight[: n - k] |= eight[k:] << np.uint64(8 * k)
    count = n - gram + 1
    h = eight[:count].copy() if gram >= 8 else eight[:count] & np.uint64((1 << 8 * gram) - 1)
    for k in range(8, gram - 7, 8):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= eight[k : k + count]
    if gram > 8 and gram % 8:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= eight[gram - 8 : gram - 8 + count]
    h = shingles.mix(h)
    # least of each run of grams in a window, with its place in the low bits
    least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(count, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # by window
    inside = np.ones(len(anchor), bool)  # windows that cross no text's end
    for e in edges:
        inside[max(0, e - length + 1) : e] = False
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, none, np.zeros(0, np.uint64), none
    windows = np.add.reduceat(inside.astype(np.int64), starts)
    return starts, windows, h[anchor[starts]], anchor[starts] - starts


def block_sizes(length: int) -> list[int]:
    """Windows in a block of a frequent anchor, by level."""
    sizes, size = [], length - min(GRAM, length) + 1
    for _ in FREQUENT:
        size = max(1, -(-size // 3))
        sizes.append(size)
    return sizes[:-1] + [1]


def blocks(windows: np.ndarray, lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut into blocks of `size` windows, counted from the anchor backwards: (segment, first
    window after its start, windows, number of the block). A size of 0 leaves a segment whole."""
    size = np.where(size > 0, size, lead + 1)
    high, low = lead // size, (lead - windows + 1) // size
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    number = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    most = np.minimum(lead[of], (number + 1) * size[of] - 1)
    least = np.maximum((lead - windows + 1)[of], number * size[of])
    return of, lead[of] - most, most - least + 1, number


def _census(length: int):
    """Hashes of anchors and how often each occurs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.small(batches, 0):
            data, at = shingles.text_buffers(batch.column(0))
            for i, j, begin, end in chunks(at, length):
                _, _, hashes, _ = segments(data[begin:end], at[i + 1 : j] - begin, length)
                seen, times = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(times)], names=["anchor", "n"])

    return apply


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(8 * len(bitmap) - 1)
    one, two = (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)
    return (bitmap[one >> 3] >> (one & 7).astype(np.uint8) & bitmap[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, n): those that occur at least twice, as a written table."""
    counted = map_arrow(texts, _census(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return materialise(counted.where("n > 1"), "anchors")


def _bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """The bitmap, as bytes, of the anchors: at most `bits` / 64 rows of it come to the driver."""
    bit = F.explode(F.array(F.col("anchor").bitwiseAND(bits - 1), F.shiftrightunsigned("anchor", 32).bitwiseAND(bits - 1)))
    words = anchors.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    if words.num_rows:
        bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return bitmap.view(np.uint8)


def _places(length: int):
    """(anchor, id, mark) of every text's anchors, each once."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.small(batches, 1):
            ids, marks = batch.column(0), batch.column(2)
            data, at = shingles.text_buffers(batch.column(1))
            for i, j, begin, end in chunks(at, length):
                starts, _, hashes, _ = segments(data[begin:end], at[i + 1 : j] - begin, length)
                docs = np.searchsorted(at, starts + begin, "right") - 1
                for d in np.unique(docs):
                    own = np.unique(hashes[docs == d])
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([ids[d].as_py()] * n, pa.int64()), pa.array([marks[d].as_py()] * n, pa.int64())], names=["anchor", "id", "mark"])

    return apply


def _same_text(other: str) -> Column:
    """Whether (id, mark) are those of `other`'s columns."""
    return F.col("id").eqNullSafe(F.col(f"{other}_id")) & (F.col("mark") == F.col(f"{other}_mark"))


def _with_lists(src: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """(id, text, mark, anchors): each text that has repeated anchors, with their list."""
    placed = materialise(map_arrow(src, _places(length), "anchor long, id long, mark long"), "anchor-places")
    lists = placed.join(anchors.select("anchor"), "anchor").groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("anchor").alias("anchors"))
    return src.join(lists, _same_text("")).select("id", "text", "mark", "anchors")


def _mark(text: Column) -> Column:
    """Tells apart texts of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _order(i: int | None, mark: int, at: int) -> tuple:
    return (i is None, i or 0, mark, at)


def _segment_rows(length: int, bitmaps):
    """Segments of repeated anchors (bytes given; part is the anchor), and intervals that are
    settled within the task (bytes null; at and at + windows are the interval's ends). Which
    anchors are repeated is told by the first of the bitmaps, or without one (None) by the rows' last
    column; which are frequent, by the others."""
    schema = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, *frequent = bitmaps.value
        known: dict[bytes, tuple] = {}  # digest of a segment: its earliest place in this task
        for batch in shingles.small(batches, 1):
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, at = shingles.text_buffers(batch.column(1))
            data, at = data[at[0] : at[-1]], at - at[0]
            whole = data.tobytes()
            for i, j, begin, end in chunks(at, length):
                if len(known) > KNOWN_SEGMENTS:
                    known.clear()
                starts, windows, hashes, lead = segments(data[begin:end], at[i + 1 : j] - begin, length)
                docs = np.searchsorted(at, starts + begin, "right") - 1
                if repeated is not None:
                    often = _in_bitmap(repeated, hashes)
                else:
                    often = np.zeros(len(starts), bool)
                    for d in np.unique(docs):
                        own = docs == d
                        often[own] = np.isin(hashes[own].view(np.int64), batch.column(3)[d].values.to_numpy())
                starts, windows, hashes, docs, lead = starts[often] + begin, windows[often], hashes[often], docs[often], lead[often]
                size = np.zeros(len(starts), np.int64)
                for width, bitmap in zip(block_sizes(length), frequent, strict=False):
                    size[_in_bitmap(bitmap, hashes)] = width
                of, skip, count, number = blocks(windows, lead, size)
                anchors_at, size = (starts + lead)[of], size[of]
                starts, windows, hashes, docs = starts[of] + skip, count, hashes.view(np.int64)[of], docs[of]
                shared = anchors_at - number * size  # where the bytes begin that all windows of a block share
                cols: list[list] = [[], [], [], [], [], []]
                doc = mark = None
                run = None  # settled interval that may go on
                for s, w, part, d, width, block, c in zip(starts.tolist(), windows.tolist(), hashes.tolist(), docs.tolist(), size.tolist(), number.tolist(), shared.tolist(), strict=True):
                    if d != doc:
                        doc, mark = d, marks[d]
                    if width:
                        part = xxhash.xxh3_64_intdigest(whole[c : c + length - width + 1], seed=block) - (1 << 63)
                    place = s - int(at[d])
                    own = _order(ids[d], mark, place)
                    piece = whole[s : s + w + length - 1]
                    key = xxhash.xxh3_128_digest(piece)
                    before = known.get(key)
                    if before is not None and before < own:
                        stop = place + w + length - 1
                        if run is not None and run[0] == d and run[1] + run[2] >= place:
                            run[2] = stop - run[1]
                        else:
                            if run is not None:
                                _put(cols, run, ids, run_mark)
                            run, run_mark = [d, place, stop - place], mark
                        continue
                    known[key] = own
                    if before == own:
                        continue  # a repeated row
                    for c, v in zip(cols, (part, ids[d], mark, place, w, piece), strict=True):
                        c.append(v)
                if run is not None:
                    _put(cols, run, ids, run_mark)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def _put(cols: list[list], run: list, ids: list, mark: int) -> None:
        for c, v in zip(cols, (mark ^ run[1], ids[run[0]], mark, run[1], run[2], None), strict=True):
            c.append(v)

    return apply


class Shards:
    """Finds repeated windows among segments that come anchor by anchor, in order of the documents."""

    def __init__(self, length: int):
        self.length = length
        self.out: list[tuple] = []  # (id, mark, from, to)
        self.held: list[tuple[tuple, bytes]] = []
        self.size = 0
        self.keys: np.ndarray | None = None  # sorted windows of the shards before, of one large anchor

    def anchor(self, rows: list[tuple[tuple, bytes]]) -> None:
        """All segments of one anchor: ((id, mark, at), bytes)."""
        first: dict[bytes, tuple] = {}
        for place, piece in rows:
            if piece in first:
                if first[piece] != place:
                    self.out.append((*place[:2], place[2], place[2] + len(piece)))
            else:
                first[piece] = place
        if len(first) < 2:
            return
        distinct = [(place, piece) for piece, place in first.items()]
        size = sum(len(piece) + 1 for _, piece in distinct)
        if size <= SHARD_BYTES:
            if self.size + size > SHARD_BYTES:
                self.flush()
            self.held += distinct
            self.size += size
            return
        self.flush()
        shard, size = [], 0
        self.keys = np.zeros(0, f"S{self.length}")
        for place, piece in distinct:
            shard.append((place, piece))
            size += len(piece) + 1
            if size > SHARD_BYTES:
                self._shard(shard)
                shard, size = [], 0
        if shard:
            self._shard(shard)
        self.keys = None

    def flush(self) -> None:
        if self.held:
            self._shard(self.held)
        self.held, self.size = [], 0

    def _shard(self, parts: list[tuple[tuple, bytes]]) -> None:
        length = self.length
        text = np.frombuffer(b"".join([piece + b"\0" for _, piece in parts]), np.uint8)
        codes = text.astype(np.uint16) + 1
        sizes = np.array([len(piece) + 1 for _, piece in parts])
        ends = np.cumsum(sizes)
        codes[ends - 1] = 0  # BREAK
        is_start = np.ones(len(codes), bool)
        for e in ends:
            is_start[e - length : e] = False
        starts = np.flatnonzero(is_start)
        again = first_equal(codes, starts, length)
        if self.keys is not None:
            windows = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
            keys = np.ascontiguousarray(windows).view(f"S{length}").ravel()
            at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            if len(self.keys):
                again |= self.keys[at] == keys
            fresh = np.sort(keys[~again])
            self.keys = np.insert(self.keys, np.searchsorted(self.keys, fresh), fresh)
        part = np.searchsorted(ends, starts, "right")
        begins = ends - sizes
        hit = np.flatnonzero(again)
        if not len(hit):
            return
        new = np.ones(len(hit), bool)
        new[1:] = (starts[hit][1:] != starts[hit][:-1] + 1) | (part[hit][1:] != part[hit][:-1])
        for a, b in zip(np.flatnonzero(new).tolist(), [*(np.flatnonzero(new)[1:] - 1).tolist(), len(hit) - 1], strict=True):
            p = int(part[hit[a]])
            (i, mark, at_), _ = parts[p]
            self.out.append((i, mark, at_ + int(starts[hit[a]] - begins[p]), at_ + int(starts[hit[b]] - begins[p]) + length))


def _intervals(length: int):
    """Intervals of repeated bytes from rows sorted by anchor and order of the documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(length)

        def emit() -> pa.RecordBatch:
            out, shards.out = shards.out, []
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "mark", "from", "to"])

        now, rows = None, []
        for batch in batches:
            part, ids, marks, at, windows, pieces = (c.to_pylist() for c in batch.columns)
            for p, i, m, a, w, piece in zip(part, ids, marks, at, windows, pieces, strict=True):
                if piece is None:
                    shards.out.append((i, m, a, a + w))
                    continue
                if p != now:
                    if len(rows) > 1:
                        shards.anchor(rows)
                    now, rows = p, []
                rows.append(((i, m, a), piece))
            yield emit()
        if len(rows) > 1:
            shards.anchor(rows)
        shards.flush()
        yield emit()

    return apply


def repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): for each text with repeated bytes its maximal runs of them, sorted.

    A byte is repeated if a string of `length` bytes that covers it also starts earlier: in a
    text of smaller id (null ids come last; texts of one id in the order of `mark`, a hash of
    the text), or earlier in the same text. Rows equal in id and text count as one text.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _mark(F.col(text_col)).alias("mark"))
    anchors = repeated_anchors(src.select("text"), length)
    sizes = anchors.agg(F.count("*"), *(F.count_if(F.col("n") > n) for n in FREQUENT)).first()
    bitmaps = [_bitmap(anchors, BITMAP_BITS) if sizes[0] <= BITMAP_ANCHORS else None]
    bitmaps += [_bitmap(anchors.where(F.col("n") > n), FREQUENT_BITS) for n, some in zip(FREQUENT, sizes[1:], strict=True) if some]
    texts = src if bitmaps[0] is not None else _with_lists(src, anchors, length)
    rows = map_arrow(texts, _segment_rows(length, docs.sparkSession.sparkContext.broadcast(bitmaps)), _SEGMENT)
    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("id").asc_nulls_last(), "mark", "at")
    found = map_arrow(dealt, _intervals(length), "id long, mark long, from long, to long")
    spans = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("s"))

    def joined(acc, x):
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["from"] <= last["to"], more).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return spans.select("id", "mark", F.aggregate("s", none, joined).alias("spans"))


def _cut(text_at: int, cols: list[str], added: list[str], as_text: bool):
    """Texts without their spans (their whole characters, if as_text), and what was removed."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.small(batches, text_at):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            kept, removed, n, total = [], [], [], []
            for text, cut in zip(batch.column(text_at), spans, strict=True):
                raw, cut = (text.as_py() or "").encode(), cut or []
                at, parts = 0, []
                for s in cut:
                    parts.append(raw[at : s["from"]])
                    at = s["to"]
                parts.append(raw[at:])
                left = b"".join(parts)
                total.append(len(raw))
                removed.append(len(raw) - len(left))
                n.append(len(cut))
                kept.append(b"".join([p.decode(errors="ignore").encode() for p in parts]) if as_text and cut else left)
            made = [pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())]
            if as_text:
                made[0] = made[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*cols, *added])

    return apply


ADDED = ("kept", "n_bytes", "n_removed", "n_spans")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, prefix: str = "") -> DataFrame:
    """`docs` with kept (the text's bytes without the repeated ones), n_bytes, n_removed, n_spans.

    What is repeated: see repeated(). Null text counts as empty; texts shorter than `length`
    lose nothing; columns of these names are replaced, others pass through. `as_text` makes
    kept a string, without characters of which only some bytes are left. `prefix` goes before
    the names of the new columns.
    """
    spans = materialise(repeated(docs, length, id_col, text_col).toDF("_dedup_id", "_dedup_mark", "_dedup_spans"), "spans")
    total = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("_dedup_spans")), F.lit(0))).first()
    added = [prefix + c for c in ADDED]
    cols = [c for c in docs.columns if c not in added]
    here = docs.select(*cols)
    side = F.broadcast(spans) if 64 * total[0] + 16 * total[1] <= BROADCAST_BYTES else spans
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_dedup_id")) & (_mark(F.col(text_col)) == F.col("_dedup_mark"))
    both = here.join(side, same, "left").select(*cols, "_dedup_spans")
    kinds = (T.StringType() if as_text else T.BinaryType(), T.LongType(), T.LongType(), T.LongType())
    schema = T.StructType([*here.schema.fields, *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    return map_arrow(both, _cut(cols.index(text_col), cols, added, as_text), schema)


def dedup_text(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` cut to the whole characters that are left. Texts that were not empty
    and of which nothing is left go."""
    out = dedup(docs, length, id_col, text_col, as_text=True, prefix="_dedup_").where("_dedup_n_removed < _dedup_n_bytes OR _dedup_n_bytes = 0")
    return out.select(*(F.col("_dedup_kept").alias(c) if c == text_col else c for c in docs.columns))
