"""Connected components of a link table by alternating large and small stars.

Each round hangs every node's neighbours on the smallest of them; the number of
rounds grows with the logarithm of a component's diameter. Links not done after `most`
rounds are an error, never a partial result. Links stay distributed:
the driver sees a count and a checksum for each round. A hub's links are rows, never collected into
one; but they are joined with an aggregate, which AQE can't split, so those of one hub are
one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node that has a link to another node; root is the smallest node of its component."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, seen = scratch.stage(edges), None
    for turn in range(most + 1):
        if turn == most:
            raise RuntimeError(f"components are not complete after {most} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        new = scratch.stage(small)
        sign = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(edges)
        edges = new
        if sign == seen:
            break
        seen = sign
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
