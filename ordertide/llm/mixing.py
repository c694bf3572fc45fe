"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents and target weight w (of all weights' sum) is to fill the
share w of `total` documents, so each of its documents is wanted lambda = total * w / n
times. Its count is the inverse of the Poisson distribution with that mean at a uniform
number hashed from the seed and the document's id: no state, the same at every
partitioning. Each document is exploded by its count and every copy is dealt to a
place hashed from seed, id and copy, which shuffles globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest mean inverted at once; larger ones are sums of equal parts below it.
PART_MEAN = 256.0
#: Sources up to which their table is broadcast; a salted shuffle join beyond.
BROADCAST_SOURCES = 100_000
SALTS = 64


def _hashed(digits: int, *parts: Column | str) -> Column:
    """The first hexadecimal digits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the hash."""
    return _hashed(13, *parts) / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where it is 1 within rounding."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, total: int | None) -> tuple[DataFrame, int]:
    """(source, parts, cdf) for each source present, and how many they are. Without `weights`
    all are equal; sources missing from `weights` get 0. Null is a source of its own."""
    counts = docs.groupBy(F.col(source).alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_given string, w double")
        weighted = counts.join(F.broadcast(given), F.col("_mix_source").eqNullSafe(F.col("_given")), "left").drop("_given").fillna(0.0, ["w"])
    sums = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    mean = F.lit(wanted) * F.col("w") / (F.lit(sums["w"]) * F.col("n")) if sums["w"] else F.lit(0.0)
    rated = weighted.withColumn("mean", mean).withColumn("_mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART_MEAN).cast("int")))
    return rated.select("_mix_source", "_mix_parts", poisson_cdf(F.col("mean") / F.col("_mix_parts")).alias("_mix_cdf")), sums["sources"]


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: int | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    source: str = "source",
    copy: str = "copy",
    place: str = "place",
) -> DataFrame:
    """`docs` replicated to the weights and shuffled: all columns, plus `copy` (from 1) and
    `place` (the order; partitions hold places dealt at random, each sorted by place).

    `total` is the number of documents wanted, by default as many as there are. Counts
    depend on the id alone, so repeated rows (and null ids, among themselves) have equal
    counts; rows without an id are dealt by their other columns. Null sources are mixed as a source of their own; `copy` and `place` replace
    columns of that name; no rows give none.
    """
    table, n = rates(docs, source, weights, total)
    cols = [c for c in docs.columns if c not in (copy, place)]
    if n <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("_mix_source")))
    else:  # a hot source is spread over SALTS tasks, its row of rates copied to each
        salted = table.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_mix_deal", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_deal") == F.col("_mix_salt")))
    below = lambda u: F.size(F.filter("_mix_cdf", lambda c: c <= u))
    draws = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda part: below(uniform(seed, F.col(id_col), part)))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("_mix_count", count).where("_mix_count > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_mix_count"))))
    placed = copies.select(*cols, copy, _hashed(15, seed, "place", F.col(id_col), F.col(copy)).alias(place))
    # rows without an id share a place for each copy, which is to be no hot key
    apart = [c for c, kind in placed.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
    return placed.repartition(F.col(place), F.when(F.col(id_col).isNull(), F.xxhash64(*apart))).sortWithinPartitions(place, id_col)


def mix_sql(documents: str = "documents", seed: str = "mix") -> str:
    """DuckDB SQL for mix() with equal weights, as many documents as there are, and means below PART_MEAN."""
    return f"""
WITH RECURSIVE r AS (
  SELECT source AS s, CAST((SELECT count(*) FROM {documents}) AS DOUBLE) / (CAST((SELECT count(DISTINCT coalesce('x' || source, '')) FROM {documents}) AS DOUBLE) * count(*)) AS mean
  FROM {documents} GROUP BY source),
c(s, mean, k, p, c) AS (
  SELECT s, mean, 0, exp(-mean), exp(-mean) FROM r
  UNION ALL
  SELECT s, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
d AS (
  SELECT d.*, CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM {documents} d),
n AS (
  SELECT d.* EXCLUDE (u), (SELECT count(*) FROM c WHERE c.s IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n FROM d)
SELECT n.* EXCLUDE (n), CAST(k AS INTEGER) AS copy,
  CAST(('0x' || substr(md5('{seed}:place:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || k), 1, 15)) AS BIGINT) AS place
FROM n, LATERAL unnest(range(1, n.n + 1)) AS t(k)
"""
