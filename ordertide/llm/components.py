"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of `edges`: label is the smallest node that it reaches.

    Each step keeps at most as many edges as there are and is one aggregation (combined
    before its shuffle) and one join, which can split a hub's edges; the number of steps
    grows with the logarithm of the size, not with the diameter. Loops, repeated edges
    and nulls are fine (nulls link nothing).
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u > v").distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        done = materialise(df, "edges")
        return done, tuple(done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now, mark = written(tidy(ends))
    first = now
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = now.union(now.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
        large, _ = written(tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        smallest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = large.join(smallest, "u").select("v", "m").union(smallest)
        before = now
        now, new = written(tidy(small.toDF("u", "v")))
        discard(least, large, smallest, *([] if before is first else [before]))
        if new == mark:
            break
        mark = new
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("label"))
