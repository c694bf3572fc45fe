"""Quality by importance resampling: hashed n-gram models of target and raw text.

The n-grams are single tokens and pairs of neighbours. A token is a run of letters, digits
and bytes beyond ASCII, or a run of other characters; one that equals the token before it
is written as a token of its own kind, the repetition. A generative model of the target is
fitted on labelled texts of good quality, one of the raw corpus on all documents; the
target's has the raw one as its prior, PSEUDO counts a bucket in the mean. A document's log
weight is the logarithm of the two models' ratio: the sum over all its n-grams. Each
stratum (a language, say) has the raw model of its own documents, and as its target that
one times the ratio, normalised: a stratum that the labels hold too little of isn't the
worse for it. Documents are resampled without replacement by Gumbel top-k: the k largest of log weight plus a
Gumbel number hashed from the id.

k is the number of documents against which there is no strong evidence: those for which
the raw model isn't exp(EVIDENCE) times as likely as the target's or more. No label takes
part in that. Weights are whole multiples of 2^-20, so sums and selection are exact and
don't depend on how documents are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .mixing import uniform
from .store import map_arrow, materialise

#: Buckets into which n-grams are hashed.
BUCKETS = 1 << 12
#: Labelled documents used at most, those whose id has the smallest hash.
LABELLED = 20_000
#: Counts of a bucket's prior in the target's model, in the mean over buckets.
PSEUDO = 50
#: Strata told apart, the largest ones; all others share one.
STRATA = 64
#: Nats against a document from which on it isn't counted in k.
EVIDENCE = 5
UNIT = 1 << 20
#: Classes into which the range of keys is divided in a step of the selection.
SELECT_CLASSES = 4096

#: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 others.
_KIND = np.full(256, 2, np.uint8)
_KIND[97:123] = _KIND[65:91] = _KIND[48:58] = _KIND[128:] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The token that stands for a repetition.
_REPEAT = np.uint64(1)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (shingles.mix(x) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, texts, froms, tos): n-grams froms[i] to tos[i] of `buckets` belong to text texts[i]."""
    last, last_text = np.uint64(0), -1  # the token before a piece, and its text
    for begin, end in shingles.slices(data, at):
        piece = data[begin:end]
        i, j = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end))
        a = np.maximum(at[i:j], begin) - begin
        b = np.minimum(at[i + 1 : j + 1], end) - begin
        texts = np.arange(i, j)
        plain, starts = shingles.slice_tokens(piece, a, _KIND)
        if not len(starts):
            continue
        wa, wb = np.searchsorted(starts, a), np.searchsorted(starts, b)
        first = np.zeros(len(plain) + 1, bool)  # tokens that begin a text
        first[wa] = True
        first[wa[0]] &= last_text != i
        before = np.concatenate([[last], plain[:-1]])
        repeats = (plain == before) & ~first[:-1]
        tokens = np.where(repeats, _REPEAT, plain)
        yield _bucket(tokens), texts, wa, wb
        if last_text == i:
            yield _bucket(last_token * _SPREAD + tokens[:1]), texts[:1], wa[:1], wa[:1] + 1
        if len(tokens) > 1:
            yield _bucket(tokens[:-1] * _SPREAD + tokens[1:]), texts, wa, np.maximum(wa, wb - 1)
        last, last_token, last_text = plain[-1], tokens[-1:], int(np.searchsorted(at, begin + starts[-1], "right")) - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket over good texts (kind 0) and over all of stratum s (kind 1 + s), one run per task."""
    counts = np.zeros((2 + STRATA, BUCKETS), np.int64)
    for batch in shingles.small(batches, 0):
        data, at = shingles.text_buffers(batch.column(0))
        good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
        stratum = batch.column(2).to_numpy(zero_copy_only=False)
        for buckets, texts, froms, tos in grams(data, at):
            sizes = tos - froms
            inside = np.repeat(froms - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            of = np.repeat(texts, sizes)
            counts += np.bincount((1 + stratum[of]) * BUCKETS + buckets[inside], minlength=counts.size).reshape(counts.shape)
            counts[0] += np.bincount(buckets[inside[good[of]]], minlength=BUCKETS)
    kind, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[kind, bucket])], names=["kind", "bucket", "n"])


@dataclass
class Model:
    """`ratios`: the logarithm of target over raw for each bucket, in whole multiples of 1/UNIT; `less`:
    the logarithm by which each stratum's target is normalised, once for each n-gram; `strata`: their
    values in order (the last of `less` is that of all other values)."""

    ratios: np.ndarray
    less: np.ndarray
    strata: list
    column: str | None

    def stratum(self) -> Column:
        """The number of a row's stratum."""
        if self.column is None:
            return F.lit(0)
        number = F.lit(STRATA)
        for i, v in enumerate(self.strata):
            number = F.when(F.col(self.column).eqNullSafe(F.lit(v)), F.lit(i)).otherwise(number)
        return number


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", quality: str = "quality", most: int = LABELLED) -> DataFrame:
    """(id, good): at most `most` labelled documents, by hash of the id; the lower label where there are two."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull())
    one = rows.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(quality).cast("int")).alias("good"))
    return materialise(one.orderBy(F.xxhash64("_id"), "_id").limit(most), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = None) -> Model:
    """Both models' ratio: raw counts from every document, target counts from the labelled sample.

    Rows that repeat an id count each, and are good ones if their id is. Without documents, or good
    labels among them, all ratios are 0. Null texts are empty; a null stratum is one of its own, and
    without `stratum` there is only one.
    """
    sizes = docs.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(STRATA).collect() if stratum else []
    model = Model(np.zeros(BUCKETS, np.int64), np.zeros(STRATA + 1, np.int64), [r[0] for r in sizes], stratum)
    sample = labelled_sample(labels, id_col)
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), model.stratum().alias("_stratum"))
    rows = rows.join(F.broadcast(sample), F.col("_own") == F.col("_id"), "left").select("_text", "good", "_stratum")
    sums = map_arrow(rows, _counted, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2 + STRATA, BUCKETS))
    if sums.num_rows:  # at most (2 + STRATA) * BUCKETS rows
        counts[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    good, raw = counts[0], counts[1:].sum(0)
    if good.sum():
        share, seen = raw / raw.sum(), raw > 0
        ratio = np.zeros(BUCKETS)
        ratio[seen] = (good[seen] + PSEUDO * BUCKETS * share[seen]) / ((good.sum() + PSEUDO * BUCKETS) * share[seen])
        model.ratios[seen] = np.rint(np.log(ratio[seen]) * UNIT)
        some = counts[1:].sum(1) > 0
        model.less[some] = np.rint(np.log((counts[1:][some] * ratio).sum(1) / counts[1:][some].sum(1)) * UNIT)
    return model


def weigh(docs: DataFrame, model: Model, text_col: str = "text", name: str = "weight") -> DataFrame:
    """`docs` plus the log weight of each, in units of 1/UNIT. Null text counts as empty and weighs 0."""
    table = docs.sparkSession.sparkContext.broadcast((model.ratios, model.less))
    cols = [c for c in docs.columns if c != name]
    where = cols.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, less = table.value
        for batch in shingles.small(batches, where):
            data, at = shingles.text_buffers(batch.column(where))
            each = less[batch.column(len(cols)).to_numpy(zero_copy_only=False)]
            sums = np.zeros(len(at) - 1, np.int64)
            for buckets, texts, froms, tos in grams(data, at):
                running = np.concatenate([[0], np.cumsum(ratios[buckets])])
                np.add.at(sums, texts, running[tos] - running[froms] - each[texts] * (tos - froms))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], names=[*cols, name])

    schema = T.StructType([*docs.select(*cols).schema.fields, T.StructField(name, T.LongType())])
    return map_arrow(docs.select(*cols, model.stratum().alias("_stratum")), apply, schema)


def gumbel(seed: str, id_col: str) -> Column:
    """A Gumbel number in units of 1/UNIT, from the hash of seed and id."""
    u = uniform(seed, F.col(id_col)) + F.lit(2.0**-53)
    return F.round(-F.log(-F.log(u)) * UNIT).cast("long")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: counts of equal classes of the range, then of
    the class that holds it, and so on. Only SELECT_CLASSES counts at a time reach the driver."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not 0 < k <= n:
        return None
    while lo < hi:
        width = -(-(hi - lo + 1) // SELECT_CLASSES)
        inside = df.where(F.col(key).between(lo, hi))
        classes = inside.groupBy(F.expr(f"({key} - {lo}L) div {width}L").alias("c")).count().orderBy(F.desc("c")).collect()
        for r in classes:
            if k <= r["count"]:
                lo, hi = lo + r["c"] * width, min(hi, lo + (r["c"] + 1) * width - 1)
                break
            k -= r["count"]
    return lo


def least_key(weighed: DataFrame, model: Model, seed: str = "quality", id_col: str = "doc_id", weight: str = "weight") -> int | None:
    """The smallest key that the resampling of `weighed` (a written table of ids and weights) keeps;
    None where it keeps everything, for want of labelled texts of good quality or of documents."""
    if not model.ratios.any():
        return None
    k = weighed.where(F.col(weight) >= -EVIDENCE * UNIT).count()
    least = kth_largest(weighed.select((F.col(weight) + gumbel(seed, id_col)).alias("key")), "key", k)
    return np.iinfo(np.int64).max if least is None else least


def kept(weighed: DataFrame, least: int | None, seed: str = "quality", id_col: str = "doc_id", weight: str = "weight", key: str = "key") -> DataFrame:
    """The rows of `weighed` that the resampling keeps, with their `key`.

    Rows at the last kept key are all kept, so repeated rows stay or go together. Null ids
    share one Gumbel number.
    """
    keyed = weighed.withColumn(key, F.col(weight) + gumbel(seed, id_col))
    return keyed if least is None else keyed.where(F.col(key) >= F.lit(least))


def resample(docs: DataFrame, labels: DataFrame, seed: str = "quality", id_col: str = "doc_id", text_col: str = "text", weight: str = "weight", key: str = "key", stratum: str | None = None) -> DataFrame:
    """The documents that are kept, with `weight` and `key` in units of 1/UNIT (these names replace
    columns, others pass through).

    Rows that repeat an id share a Gumbel number and have each the weight of its text. Null and empty
    texts weigh 0. Without good labels among the documents all are kept; no documents give none.
    """
    model = fit(docs, labels, id_col, text_col, stratum)
    weighed = weigh(docs, model, text_col, weight)
    table = materialise(weighed.select(id_col, weight), "weights")
    return kept(weighed, least_key(table, model, seed, id_col, weight), seed, id_col, weight, key)
