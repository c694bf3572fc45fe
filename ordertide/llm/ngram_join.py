"""Exact Jaccard join of documents on their sets of word shingles, with adaptive prefixes.

Equal sets are one node. The shingles of a node are ordered from rare to common: those
that occur often (counted over all documents) come last, by their counts. Two sets that
overlap in O shingles share at least m among their first |x| - O + m and |y| - O + m, so
any m will do as a filter: a longer prefix lets one demand m common shingles instead of
one. Each node chooses its m by the cost that its shingles' exact counts foretell, and a
pair demands the smaller m of the two, at places that the sizes of both leave room for.
Pairs that pass are verified on the whole sets.

Only links that can change a component are looked for. First every node is paired with
the most central node of each shingle group (a number of pairs in proportion to the
prefixes, however large a group is); the links found give first components. Then pairs
across these are made by a join on shingles, which drops a pair at once where sizes or
parity bitmaps show that the sets differ too much. Within a component no pair is needed.

Nodes whose lists would cost more than their own set are dear: such as the variants of one
text that lie apart. Cheap nodes meet all others in the lists, which is linear by their
definition. Dear nodes meet each other in an order of their own: all their shingles are
counted exactly among them, so that what only one of them has comes first and fills the
prefixes of those that lie apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .components import components
from .store import discard, map_arrow, materialise

#: Levels that a node chooses among: the number of prefix shingles that a partner must share.
LEVELS = 4
#: Cost of verifying a pair, in units of reading an entry of a shingle's list.
VERIFY_COST = 30
#: Shingles are counted exactly in runs of this many; those seen twice in a run are summed over all runs.
RUN_SHINGLES = 1 << 20
#: Common shingles that every task knows, at most (16 bytes each), and their least count.
COMMON_MOST, COMMON_LEAST = 1 << 20, 16
#: Entries of a shingle's list that one task counts: longer lists are dealt in shares by node.
LIST_ENTRIES = 100_000
#: A node is dear if the lists of its prefix hold more than 1 / CHEAP_SHARE entries of fitting size for
#: each of its shingles.
CHEAP_SHARE = 2
#: Nodes up to which their list is broadcast (16 bytes each); a shuffle join beyond.
BROADCAST_NODES = 1_000_000
#: Longs in the bitmaps that go with every list entry, and in those that pairs are sifted by.
BITMAP_WORDS, WIDE_WORDS = 4, 32

_CENSUS = "kind int, id long, node long, other long, n long, b0 long, b1 long, b2 long, b3 long, shingle long, times long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _hashes(tokens: np.ndarray, bits: int) -> tuple[int, int]:
    """Two 64-bit hashes of the set, of the first only the last `bits`."""
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    halves = np.array([h & ((1 << bits) - 1), h >> 64], np.uint64).view(np.int64)
    return int(halves[0]), int(halves[1])


@dataclass
class Numbers:
    """How sets are numbered: by their first hash, or by the second where `apart` says that two sets
    share the first. Of N sets about N * N / 2 ** 65 do: three of 10 ** 10."""

    bits: int = 64
    apart: frozenset[tuple[int, int]] = frozenset()

    def __call__(self, tokens: np.ndarray) -> int:
        both = _hashes(tokens, self.bits)
        return both[1] if both in self.apart else both[0]


def _bitmap(tokens: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """For each of 64 * words classes of shingles, whether the set has an odd number of them."""
    odd = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _census(words: int, bits: int):
    """Per document its hashes, size and bitmap (kind 0); repeated shingles and their counts (kind 1)."""
    schema = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.int64()) for c in _CENSUS.split(", ")])

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        zero = np.zeros(size, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, zero), f.type) for f in schema], schema=schema)

    def counted(run: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(run), return_counts=True)
        often = times > 1
        return rows(kind=np.ones(int(often.sum()), np.int64), shingle=_signed(tokens[often]), times=times[often])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, seen = [], 0, set()
        for batch in shingles.small(batches, 1):
            ids = batch.column(0)
            nodes, others, sizes, maps = [], [], [], []
            for tokens in shingles.sets(batch.column(1), words):
                node, other = _hashes(tokens, bits)
                nodes.append(node)
                others.append(other)
                sizes.append(len(tokens))
                maps.append(_bitmap(tokens))
                if len(tokens) and node not in seen:
                    seen.add(node)
                    run.append(tokens)
                    held += len(tokens)
                if held >= RUN_SHINGLES:
                    yield counted(run)
                    run, held, seen = [], 0, set()
            packed = np.array(maps, np.int64).reshape(-1, BITMAP_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(nodes), np.int32)), ids.cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()),
                    *(pa.array(packed[:, i]) for i in range(BITMAP_WORDS)), *(pa.array(np.zeros(len(nodes), np.int64)) for _ in range(2)),
                ],
                schema=schema,
            )
        if run:
            yield counted(run)

    return apply


def _common(census: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, at most COMMON_MOST, sorted, with their counts. They only decide
    the order of shingles; which of them are known changes no result."""
    totals = materialise(census.where("kind = 1").groupBy("shingle").agg(F.sum("times").alias("times")).where(f"times >= {COMMON_LEAST}"), "common")
    by_size = totals.groupBy(F.floor(F.log2("times") * 8).alias("size")).agg(F.count("*").alias("n"), F.min("times").alias("least")).orderBy(F.desc("size")).collect()
    known, least = 0, None
    for r in by_size:  # a few hundred classes at most
        known += r["n"]
        if known > COMMON_MOST:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = totals.where(F.col("times") >= least).select("shingle", "times").toArrow()
    tokens, times = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def _prefixes(words: int, num: int, den: int, common, number: Numbers):
    """Per node its rarest shingles in their order: of the longest prefix that a partner may call for.
    share is 0, or from 1 for shingles so common that their list is dealt in shares."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        seen: set[int] = set()
        for batch in shingles.small(batches, 0):
            tokens_out, nodes_out, places_out, sizes_out, shares_out = [], [], [], [], []
            for tokens in shingles.sets(batch.column(0), words):
                size = len(tokens)
                if not size or (node := number(tokens)) in seen:
                    continue
                seen.add(node)
                need = -(-num * size // den)  # overlap with any partner, at least
                first = size - need + 1
                length = min(size, first + min(LEVELS, need) - 1)
                share = np.zeros(length, np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    hot = known[at] == tokens
                    rare, often = tokens[~hot], tokens[hot]
                    if len(rare) < length:
                        by = np.lexsort((often, times[at[hot]]))[: length - len(rare)]
                        shares = times[at[hot]][by] // LIST_ENTRIES + 1
                        share[len(rare) :] = np.where(shares > 1, node % shares + 1, 0)
                        rare = np.concatenate([rare, often[by]])
                    tokens = rare
                tokens_out.append(tokens[:length])
                nodes_out.append(np.full(length, node, np.int64))
                places_out.append(np.arange(length, dtype=np.int32))
                sizes_out.append(np.full(length, size, np.int32))
                shares_out.append(share)
            if tokens_out:
                columns = [pa.array(np.concatenate(x)) for x in (tokens_out, nodes_out, places_out, sizes_out, shares_out)]
                yield pa.RecordBatch.from_arrays([columns[0].view(pa.int64()), *columns[1:]], names=["shingle", "node", "place", "n", "share"])

    return apply


def _whole_sets(words: int, number: Numbers):
    """(node, shingles, wide bitmap) of documents that stand for their node."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.small(batches, 0):
            nodes, tokens, wide = [], [], []
            for wanted, t in zip(batch.column(1).to_pylist(), shingles.sets(batch.column(0), words), strict=True):
                if number(t) == wanted:
                    nodes.append(wanted)
                    tokens.append(_signed(t))
                    wide.append(_bitmap(t, WIDE_WORDS))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, longs), pa.array(wide, longs)], names=["node", "shingles", "wide"])

    return apply


def _all_shingles(words: int, number: Numbers):
    """(shingle, node): every shingle of documents that stand for their node."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.small(batches, 0):
            for wanted, t in zip(batch.column(1).to_pylist(), shingles.sets(batch.column(0), words), strict=True):
                if number(t) == wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(t)), pa.array(np.full(len(t), wanted, np.int64))], names=["shingle", "node"])

    return apply


def _overlap(num: int, den: int, a: str, b: str) -> Column:
    """The shingles that sets of sizes a and b share at least if they are similar enough."""
    return F.expr(f"({num} * ({a} + {b}) + {num + den - 1}) div {num + den}")


def _band(num: int, den: int) -> Column:
    """A number for sizes n so that sets of similar enough sizes differ by one at most. (The bands are
    wider than need be by more than rounding could matter.)"""
    if num == den:
        return F.col("n").cast("long")
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).cast("long")


def _may_link(num: int, den: int) -> Column:
    """Whether sizes and bitmaps of a and b leave room for the similarity: both sets have at most
    (1 - t) / (1 + t) of their sizes' sum apart, and each odd difference of a class is one apart."""
    na, nb = F.col("a.n"), F.col("b.n")
    apart = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(BITMAP_WORDS)), F.lit(0))
    return (na * den >= nb * num) & (nb * den >= na * num) & (apart * (den + num) <= (na + nb) * (den - num))


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(text, node): the texts of the documents that stand for `nodes` (node, doc)."""
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    return docs.join(wanted, docs["id"] == wanted["doc"]).select("text", "node")


def _verified(made: DataFrame, docs: DataFrame, info: DataFrame, words: int, num: int, den: int, number: Numbers) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose whole sets are similar enough, as a written table."""
    pairs = materialise(made, "pairs")
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(info.select("node", "doc"), "node"), "pair-nodes")
    sets = materialise(map_arrow(_texts_of(nodes, docs), _whole_sets(words, number), "node long, shingles array<long>, wide array<long>"), "sets")
    of = lambda side, c: sets.select(F.col("node").alias(side), F.size("shingles").alias(f"{side}_n"), F.col(c).alias(f"{side}_{c}"))

    # the wide bitmaps, of a few hundred bytes, leave hardly any pair that isn't a link
    sifted = pairs.join(of("a", "wide"), "a").join(of("b", "wide"), "b")
    apart = F.aggregate(F.zip_with("a_wide", "b_wide", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    sifted = materialise(sifted.where(apart * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num)).select("a", "b"), "sifted")

    both = sifted.join(of("a", "shingles"), "a").join(of("b", "shingles"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    links = materialise(both.where(common * den >= (F.col("a_n") + F.col("b_n") - common) * num).select("a", "b"), "verified")
    discard(pairs, nodes, sets, sifted)
    return links


def _need(num: int, den: int) -> Column:
    """The shingles that a set of size n shares with any partner at least."""
    return F.expr(f"({num} * n + {den - 1}) div {den}")


def _with_levels(entries: DataFrame, num: int, den: int) -> DataFrame:
    """`entries` (shingle, node, n, place, times) within the prefixes that their nodes choose, with m and
    central: the least of the costs of reading lists and of verifying who shares m of the prefix."""
    level = F.col("place") - F.col("n") + _overlap(num, den, "n", "n") + 1
    read = [F.sum(F.when(level <= m, F.col("times") - 1).otherwise(0)) for m in range(1, LEVELS + 1)]
    costs = [F.struct((r * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m")) for m, r in enumerate(read, 1)]
    chosen = entries.groupBy("node").agg(F.least(*costs).getField("m").alias("m"), F.sum("times").alias("central"))
    both = entries.join(chosen, "node").withColumn("m", F.least("m", _need(num, den)).cast("int"))
    return both.where(F.col("place") < F.col("n") - _need(num, den) + F.col("m"))


def _listed(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`lists` with the times that each shingle occurs among nodes, where more than once; the table to
    discard afterwards). Shares of a list are counted apart and summed. Lists in shares are of
    shingles that every task knows, COMMON_MOST at most, so their sums can be broadcast."""
    counted = lists.repartition("shingle", "share").dropDuplicates(["shingle", "share", "node"])
    inside = F.count("*").over(Window.partitionBy("shingle", "share"))
    written = materialise(counted.withColumn("times", inside).where("times > 1 OR share > 0"), "entries")
    sums = written.where("share > 0").groupBy("shingle").agg(F.count("*").alias("_times"))
    summed = written.join(F.broadcast(sums), "shingle", "left").withColumn("times", F.coalesce("_times", "times"))
    return summed.where("times > 1").drop("_times", "share"), written


def _candidates(left: DataFrame, right: DataFrame, ordered: Column, num: int, den: int) -> DataFrame:
    """(a, b): pairs across labels that share enough of their prefixes. `ordered` (on a and b) is to leave
    each pair in one order. Shingles count where they lie in the prefixes that these two sizes call for."""
    least_m, overlap = F.least("a.m", "b.m"), _overlap(num, den, "a.n", "b.n")
    early = (F.col("a.place") < F.col("a.n") - overlap + least_m) & (F.col("b.place") < F.col("b.n") - overlap + least_m)
    return (
        left.alias("a")
        .join(right.alias("b"), F.col("a.shingle") == F.col("b.shingle"))
        .where(ordered & (F.col("a.label") != F.col("b.label")) & early & _may_link(num, den))
        .groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"), least_m.alias("m"))
        .agg(F.count("*").alias("shared"))
        .where("shared >= m")
        .select("a", "b")
    )


def _among_dear(dear: DataFrame, docs: DataFrame, words: int, num: int, den: int, number: Numbers) -> DataFrame:
    """Prefixes of the `dear` nodes (node, doc, n) in the order of exact counts among them. Counts are
    summed before their shuffle and met by a join that can be split; what one node alone has goes
    no further, it only moves the places of the others."""
    tokens = materialise(map_arrow(_texts_of(dear.select("node", "doc"), docs), _all_shingles(words, number), "shingle long, node long"), "dear-shingles")
    times = materialise(tokens.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "dear-times")
    shared = tokens.join(times, "shingle").join(dear.select("node", "n"), "node")
    by = Window.partitionBy("node")
    placed = shared.withColumn("place", F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("times", "shingle")) - 1)
    longest = F.col("n") - _need(num, den) + F.least(F.lit(LEVELS), _need(num, den))
    prefixes = materialise(placed.where(F.col("place") < longest), "dear-prefixes")
    discard(tokens, times)
    return _with_levels(prefixes, num, den)


def _numbered(census: DataFrame, bits: int) -> tuple[DataFrame, Numbers]:
    """Kind 0 of the census, and the numbers of sets. Sets that share their first hash are so few (see
    Numbers) that the driver tells them to every task."""
    info = census.where("kind = 0").select("id", "node", "other", "n", *(f"b{i}" for i in range(BITMAP_WORDS)))
    shared = materialise(info.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("node", "lo"), "shared-hashes")
    apart = info.join(F.broadcast(shared), "node").where("other > lo").select("node", "other").distinct().collect()
    number = Numbers(bits, frozenset((r["node"], r["other"]) for r in apart))
    if apart:
        few = census.sparkSession.createDataFrame(apart, "node long, other long").withColumn("_apart", F.lit(True))
        info = info.join(F.broadcast(few), ["node", "other"], "left").withColumn("node", F.when(F.col("_apart"), F.col("other")).otherwise(F.col("node"))).drop("_apart")
    return info.drop("other"), number


def join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """(`id_col`, n_shingles, component_id) for every row of `docs`.

    Two documents link when their Jaccard similarity is at least num / den; component_id is
    the smallest id that links reach, the document's own included. Texts without words have
    an empty set and link with nothing; rows with a null id have a null component and are no
    bridge. Rows of one id are one document of several texts: it links with whatever one of
    them links with, and all its rows have one component. Shingles are compared by 64-bit
    hashes, sets by 128 bits. Columns besides the two are not read. `hash_bits`: see Numbers;
    fewer than 64 serve tests.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    census = materialise(map_arrow(src, _census(words, hash_bits), _CENSUS), "census")
    info, number = _numbered(census, hash_bits)
    maps = [f"b{i}" for i in range(BITMAP_WORDS)]
    nodes = materialise(info.where("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("doc"), F.max("n").alias("n"), *(F.max(b).alias(b) for b in maps)), "nodes")

    # texts of one id are linked by it; its rows without words go with those that have some
    worded = F.when(F.col("n") > 0, F.col("node"))
    by_id = info.where("id IS NOT NULL").groupBy("id").agg(F.min(worded).alias("b"), F.max(worded).alias("hi"), F.min("n").alias("least")).where("b < hi OR b IS NOT NULL AND least = 0")
    by_id = materialise(by_id.select("id", "b"), "ids-of-several-texts")
    bridges = materialise(info.join(by_id, "id").where("n > 0 AND node != b").select(F.col("node").alias("a"), "b").distinct(), "bridges")

    common = spark.sparkContext.broadcast(_common(census))
    lists = map_arrow(src.where("id IS NOT NULL").select("text"), _prefixes(words, num, den, common, number), "shingle long, node long, place int, n int, share int")
    listed, counted = _listed(lists)
    entries = materialise(_with_levels(listed, num, den).join(nodes.select("node", *maps), "node"), "prefixes")

    hubs = entries.groupBy("shingle").agg(F.max(F.struct("central", "node", "n", *maps)).alias("hub"))
    hubs = materialise(hubs.select("shingle", "hub.*"), "hubs")
    first = entries.alias("a").join(hubs.alias("b"), "shingle").where((F.col("a.node") != F.col("b.node")) & _may_link(num, den))
    pair = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]
    links = _verified(first.select(*pair).distinct(), src, nodes, words, num, den, number)
    links = links.unionByName(bridges)
    labels = materialise(components(links), "labels")
    discard(counted, hubs)

    labelled = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialise(labelled, "labelled")
    discard(entries)
    mixed = labelled.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
    mixed = materialise(mixed, "mixed")
    shared = materialise(labelled.join(mixed, "shingle").withColumn("band", _band(num, den)), "shared")
    discard(labelled, mixed)
    # of a list only entries of the own size band and its neighbours can be partners
    in_band = shared.groupBy("shingle", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("long"))
    near = in_band.select("shingle", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "lo", "hi", "long")
    near = near.groupBy("shingle", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("long").alias("long")).where("lo < hi")
    near = materialise(near.select("shingle", "band", "long"), "near")
    across = materialise(shared.join(near, ["shingle", "band"]).drop("band"), "across")
    discard(shared, near)
    dear = across.groupBy("node").agg(F.max("n").alias("n"), F.max("label").alias("label"), F.sum(F.col("long") - 1).alias("cost")).where(F.col("cost") * CHEAP_SHARE > F.col("n"))
    dear = materialise(dear.join(nodes.select("node", "doc", *maps), "node"), "dear")
    left = materialise(across.join(dear.select("node", F.lit(True).alias("dear")), "node", "left").withColumn("dear", F.coalesce("dear", F.lit(False))), "left")
    cheap = _candidates(left.where("NOT dear"), left, F.col("b.dear") | (F.col("a.node") < F.col("b.node")), num, den)
    apart = materialise(_among_dear(dear, src, words, num, den, number).join(dear.select("node", "label", *maps), "node"), "dear-entries")
    more = _verified(cheap.unionByName(_candidates(apart, apart, F.col("a.node") < F.col("b.node"), num, den)), src, nodes, words, num, den, number)
    discard(across, left, apart, dear, labels)
    labels = materialise(components(links.union(more)), "labels")

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = materialise(named.join(materialise(smallest, "smallest"), "label").select("node", "component_id"), "components")
    if not by_id.isEmpty():
        info = info.join(by_id, "id", "left").withColumn("node", F.when(F.col("n") == 0, F.coalesce("b", "node")).otherwise(F.col("node"))).drop("b")
    out = info.join(named, "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
