"""Connected components of a link table by alternating large and small stars.

The published two-step scheme: every vertex first hooks its larger neighbours
to its least neighbour, then its smaller ones.  Each round is a pre-aggregated
minimum and an equi-join on vertex ids; the links shrink towards stars, and
the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spill import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex but the least of each component.

    ``links`` has two bigint columns ``a`` and ``b``; order, repeats and loops do
    not matter.  ``component`` is the least id that can be reached; ids that
    are absent from the result are their own component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = checkpointed(edges)
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if (state["n"], state["x"]) == mark or not state["n"]:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
        mark = (state["n"], state["x"])
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = checkpointed(small.union(low.select("v", F.col("m").alias("u"))).distinct())
