"""Exact top-k by inner product: columnar branch and bound over blocks of vectors.

Candidates stay where they are. Queries go to them, in parts of bounded size that every
task gets whole; each part takes one pass over the candidates. A task takes candidates in
blocks that lie column by column, the columns of the largest components first. For a query
the columns are taken a few at a time; after each step a candidate's score can't exceed its
partial sum plus the product of the norms that are left on both sides (Cauchy and Schwarz).
Candidates whose bound is under the k-th best score that the task has found for the query
are dropped and the columns compacted to the survivors. Each task gives its k best of a
query; the best of these are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import map_arrow, materialise

#: Candidates in a block, and queries whose first columns are multiplied at once.
CANDIDATES, QUERIES = 4096, 256
#: Bytes of the queries that go to every task at once.
QUERY_BYTES = 16 << 20
#: Candidates that a task has at least where there are too few for all tasks.
LEAST_CANDIDATES = 256
#: Components taken at once.
STEP = 16
#: While more than this share of the candidates is left, they aren't copied.
COMPACT_BELOW = 0.7
#: Integers below this are exact as doubles, sums included; and the range of scores.
EXACT, LONGEST = 1 << 52, (1 << 63) - 1


def matrix(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row for each vector, zeros behind shorter ones. Doubles, or
    Python's integers where a double would not be exact."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = np.asarray(vectors.offsets)
    flat = np.asarray(vectors.values.slice(offsets[0], offsets[-1] - offsets[0]))
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(x) * scale if abs(x) > 2**60 else int(np.floor(x * scale)) for x in row] for row in out], object).reshape(out.shape)


def _fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which inner products of their rows are exact."""
    largest = [max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < EXACT:
        return a.astype(np.float64), b.astype(np.float64)
    return tuple(np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b))


class Block:
    """Candidates column by column, columns of most mass first, and for each step the norms that are left."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, step: int = STEP):
        self.ids = ids
        if rows.dtype == object:  # too large for bounds: all at once
            step = max(1, rows.shape[1])
            squares = np.zeros(rows.shape)
        else:
            squares = rows**2
        self.order = np.argsort(-squares.sum(0), kind="stable")
        self.columns = np.ascontiguousarray(rows[:, self.order].T)
        self.ends = list(range(step, len(self.order), step)) + [len(self.order)]
        mass = squares[:, self.order]
        # a little more than what is left, whatever the rounding
        self.left = [np.sqrt(np.ascontiguousarray(mass[:, e:]).sum(1)) * (1 + 1e-9) for e in self.ends]

    def starts(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries with their components in this block's order, and their scores over the first step."""
        mine = queries[:, self.order]
        return mine, mine[:, : self.ends[0]] @ self.columns[: self.ends[0]] if len(self.order) else np.zeros((len(mine), len(self.ids)), mine.dtype)

    def best(self, query: np.ndarray, partial: np.ndarray, own: int, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of candidates among which are the k best of one query, its own id's left out.
        `least`: the k-th best score known so far, if there are as many."""
        left = np.flatnonzero(self.ids != own)
        whole = len(left) == len(self.ids)
        partial, data = (partial, self.columns) if whole else (partial[left], self.columns[:, left])
        for i, end in enumerate(self.ends):
            if i:
                partial = partial + query[self.ends[i - 1] : end] @ data[self.ends[i - 1] : end]
            if end == len(query) or len(left) <= k:
                continue
            spread = np.ceil(np.sqrt((query[end:] ** 2).sum()) * (1 + 1e-9) * self.left[i][left] + 1e-6)
            bound = least
            if bound is None:
                bound = np.partition(partial - spread, len(left) - k)[len(left) - k]
            keep = partial + spread >= bound
            if keep.sum() < COMPACT_BELOW * len(keep):
                left, partial, data = left[keep], partial[keep], data[:, keep]
        if partial.dtype == object:
            partial = np.array([max(-LONGEST - 1, min(LONGEST, x)) for x in partial], object)
        return self.ids[left], partial


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of largest score, ties to the smaller id."""
    if scores.dtype == object:
        top = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[top], scores[top]
    if len(ids) > k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[enough], scores[enough]
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def _search(part, width: int, k: int, scale: int):
    """Each query's k best of a task's candidates."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, flat = part.value
        queries = matrix(flat, width, scale)
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)

        def take(rows: np.ndarray, ids: np.ndarray) -> None:
            rows, asking = _fitting(rows, queries)
            block = Block(rows, ids)
            for begin in range(0, len(query_ids), QUERIES):
                mine, partial = block.starts(asking[begin : begin + QUERIES])
                for j in range(len(mine)):
                    q = begin + j
                    had_ids, had = found[q]
                    more_ids, more = block.best(mine[j], partial[j], query_ids[q], k, had[-1] if len(had) == k else None)
                    found[q] = first_k(np.concatenate([had_ids, more_ids]), np.concatenate([had, more]), k)

        full = max(1, min(CANDIDATES, QUERY_BYTES // (8 * max(1, width))))
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= full:
                table = pa.Table.from_batches(held)
                take(matrix(table.column(1), width, scale), table.column(0).to_numpy())
                held, n = [], 0
        if n:
            table = pa.Table.from_batches(held)
            take(matrix(table.column(1), width, scale), table.column(0).to_numpy())
        sizes = [len(ids) for ids, _ in found]
        if sum(sizes):
            scores = [int(s) for _, all_ in found for s in all_.tolist()]
            columns = (np.repeat(query_ids, sizes), np.concatenate([ids for ids, _ in found]), scores)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return apply


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k candidates of largest integer
    inner product of the scaled vectors, ties to the smaller id; all where there are fewer.

    Candidates are all rows but those of the query's own id. Null vectors, null ids and
    vectors with a null or non-finite component take no part; shorter vectors count as
    ending in zeros. Every row is a candidate of its own, also where ids or vectors are
    equal; query rows of one id share its ranks. Scores are exact; those beyond a long's
    range count as its ends. Columns besides the two are read only by `is_query`.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & good)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    candidates = rows.select("id", "v")
    n, width, asking = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("asks")).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(tasks, n // LEAST_CANDIDATES))
    if candidates.rdd.getNumPartitions() < tasks:
        candidates = materialise(candidates.repartition(tasks), "candidates")

    parts = max(1, -(-asking * 8 * max(1, width) // QUERY_BYTES))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
    queries = materialise(rows.where("asks").select("id", "v", part.alias("part")), "queries")
    found = None
    for p in range(parts):
        own = queries.where(F.col("part") == p).select("id", "v").toArrow()
        told = df.sparkSession.sparkContext.broadcast((own.column(0).to_numpy(), own.column(1).combine_chunks()))
        here = map_arrow(candidates, _search(told, width, k, scale), "query_id long, vec_id long, score long")
        found = here if found is None else found.unionByName(here)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
