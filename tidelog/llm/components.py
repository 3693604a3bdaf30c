"""Connected components by alternating star contraction, in DataFrame operations.

Every round is two group-bys and two joins on rows of two longs and is written to the shared folder, so no
links or components are ever on the driver and a lost executor repeats one round at most. Rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, stored


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.filter("a != b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(small).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(links: DataFrame) -> DataFrame:
    """links: two long columns. Returns node and root (the component's smallest node) of every linked node but roots."""
    a, b = links.columns
    edges = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "links")
    before, now = None, _state(edges)
    while now != before and now[0]:
        old, edges = edges, stored(_stars(edges), "links")
        discard(old)
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
