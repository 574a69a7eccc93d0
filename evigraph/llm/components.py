"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import stored

#: Rounds grow with the logarithm of the longest chain; this many mean a fault.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's least.

    Each round hangs every node's larger neighbours on its least neighbour, then every
    node's smaller neighbours on the least of them, until nothing changes. Minima combine
    before the shuffle, so a node with many links is one row per task; the links of such a
    node spread over tasks when they are joined with its minimum, as Spark splits that side.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                               F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), "m")
        large = large.where("a <> m").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr(
            "bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("the contraction did not end")
