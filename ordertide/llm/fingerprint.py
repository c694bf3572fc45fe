"""Canonical exact digests of texts, in DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC once more (folding can denormalise),
each run of white space as one space, none at the ends. The digest is two chained
64-bit xxhashes of it in hexadecimal. Texts whose digests are equal are put into
one class only after their canonical bytes have been compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise

#: Second hash of the pair: xxhash64 takes the hash of this literal as its seed.
SECOND_SEED = "canonical"
#: Rows of the table of repeated digests up to which it is broadcast (24 bytes a row); a shuffle join beyond.
BROADCAST_ROWS = 1_000_000


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    icu = lambda name, kind, c: F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(name), c, F.lit(True))
    folded = icu("foldCase", "lang.UCharacter", icu("compose", "text.Normalizer", F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(icu("compose", "text.Normalizer", folded), r"\p{IsWhite_Space}+", " "))


def _hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def digest(canon: Column) -> Column:
    """32 hexadecimal digits for a canonical form."""
    return F.concat(_hex(F.xxhash64(canon)), _hex(F.xxhash64(F.lit(SECOND_SEED), canon)))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def classes(prints: DataFrame, id_col: str, text_col: str, print_col: str = "fingerprint") -> DataFrame:
    """Classes of equal canonical texts: one row per repeated digest and member, as
    (`id_col`, `fingerprint`, `class_id`), class_id being the smallest id of the class.

    `prints` has every text with its digest. Ids that stand alone under their digest aren't
    listed: they are their own class. Inside each digest every member is compared byte by
    byte with the member of the smallest id, which is the only row that a large group shares;
    members that differ (a hash collision) form classes of their own by SHA-256. Repeated ids
    and rows give one row per (id, digest); null ids take no part.
    """
    rows = prints.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(print_col).alias("fingerprint")).where(F.col(id_col).isNotNull())
    repeated = rows.groupBy("fingerprint").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "first_id")
    repeated = materialise(repeated, "class-repeated")
    members = _joined(rows, repeated, ["fingerprint"], "inner", repeated.count())
    members = materialise(members.select("id", "fingerprint", "first_id", canonical(F.col("text")).alias("canon")), "class-members")
    # both are written, so that the joins deal their sides themselves and can split a large class
    firsts = materialise(members.where("id = first_id").groupBy("fingerprint").agg(F.min("canon").alias("first_canon")), "class-firsts")
    same = F.col("canon") == F.col("first_canon")
    compared = members.join(firsts, "fingerprint").select("id", "fingerprint", "first_id", same.alias("same"), F.when(~same, F.sha2("canon", 256)).alias("strong"))
    compared = materialise(compared, "class-compared")
    discard(repeated, members, firsts)
    agree = compared.where("same").select(F.col("id").alias(id_col), "fingerprint", F.col("first_id").alias("class_id"))
    collide = compared.where("not same")
    others = collide.groupBy("fingerprint", "strong").agg(F.min("id").alias("class_id"))
    apart = collide.join(others, ["fingerprint", "strong"]).select(F.col("id").alias(id_col), "fingerprint", "class_id")
    return agree.unionByName(apart).distinct()


#: Blocks of ids at most, and ranges in one: with 16 MB in a range they do for 16 TB, and grow beyond
#: (100 MB at 100 TB).
BLOCKS, RANGES = 1024, 1024


def _bounds(parts: int, id_col: str = "_next_id") -> Column:
    """Up to `parts` - 1 values that cut the column into about equal parts, ascending."""
    marks = [i / parts for i in range(1, parts)]
    return F.array_sort(F.array_distinct(F.percentile_approx(id_col, marks, 10 * parts))) if marks else F.array().cast("array<bigint>")


def _with_range(src: DataFrame, parts: int) -> DataFrame:
    """`src` plus `_part`, the number of its range of `_next_id`, descending; null ids are the last.

    A thousand bounds at most are told to all tasks, which make blocks; each block has a row of
    bounds of its own in a small table, which is broadcast.
    """
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("_next_id")))
    blocks = min(BLOCKS, parts)
    coarse = src.agg(_bounds(blocks).alias("b")).first()["b"] or []
    src = src.withColumn("_block", F.when(F.col("_next_id").isNotNull(), below(F.array(*(F.lit(b).cast("long") for b in coarse)).cast("array<bigint>"))))
    inner = min(RANGES, -(-parts // blocks))
    if inner > 1:
        fine = src.where("_block IS NOT NULL").groupBy("_block").agg(_bounds(inner).alias("_fine"))
        src = src.join(F.broadcast(materialise(fine, "ranges")), "_block", "left").withColumn("_inner", below(F.col("_fine"))).drop("_fine")
    else:
        src = src.withColumn("_inner", F.lit(0))
    first = F.lit((len(coarse) + 1) * RANGES)
    return src.withColumn("_part", F.coalesce(first - F.col("_block") * RANGES - F.col("_inner"), first + 1).cast("long")).drop("_block", "_inner")


def with_next(df: DataFrame, id_col: str, carry: list[str], order: list[str], range_bytes: int = 16 << 20, size_col: str = "text") -> DataFrame:
    """`df` plus `next_<c>` for each c of `carry`: the value in the next row by descending
    `id_col` (ties by `order`, null ids last), after the last row that of the first.

    Rows are dealt into ranges of the id of about `range_bytes` of `size_col`; the first
    row of each range is copied to the end of the range before, so no global order is
    ever made in one task. The table of ranges has one small row per range, a million at most.
    """
    src = df.withColumn("_next_id", F.col(id_col).cast("long"))
    total = src.agg(F.sum(F.octet_length(size_col)).alias("b")).first()["b"] or 0
    parts = min(BLOCKS * RANGES, max(1, total // range_bytes))
    if parts > 1:  # several for each task, or chance would give some tasks much more than others
        parts = max(parts, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = _with_range(src, parts)
    firsts = materialise(src.groupBy("_part").agg(F.max("_next_id").alias("_border")), "range-firsts")
    # the first range's first row follows the last one
    by = Window.partitionBy(F.lit(0)).orderBy("_part")
    borders = firsts.select("_border", F.coalesce(F.lag("_part").over(by), F.max("_part").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    guests = (
        src.join(F.broadcast(materialise(borders, "range-borders")), F.col("_next_id").eqNullSafe(F.col("_border")))
        .withColumn("_part", F.col("_to"))
        .drop("_border", "_to")
        .withColumn("_guest", F.lit(1))
    )
    dealt = src.withColumn("_guest", F.lit(0)).unionByName(guests)
    by = Window.partitionBy("_part").orderBy("_guest", F.col("_next_id").desc_nulls_last(), *order)
    for c in carry:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(by))
    return dealt.where("_guest = 0").drop("_guest", "_part", "_next_id")


def edited(text: Column, next_text: Column) -> Column:
    """The text, its last third of code points replaced by the first as many of the next text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(next_text, F.lit(1), third))


def likeness(a_print: Column, b_print: Column, a_text: Column, b_text: Column) -> Column:
    """1 where digests and canonical bytes are equal, else 0; bytes are read only for equal digests."""
    return F.when(a_print != b_print, F.lit(0.0)).when(canonical(a_text) == canonical(b_text), F.lit(1.0)).otherwise(F.lit(0.0))
