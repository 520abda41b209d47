"""Connected components by contraction, over edges that are never gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.storage import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge ``(u, v)`` of longs; a component has one root.

    In each round a node takes the smallest name among itself and its neighbours, names being
    hashes of nodes so that chains shrink by a constant factor; edges are renamed, and those
    within a node fall away. Rounds grow with the logarithm of the longest chain. Minima are
    combined before the shuffle, so a node of very many edges costs no more than others.
    """
    first = edges.filter("u <> v").select(F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b"), "u", "v")
    names = stored(first.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("at")), F.struct(F.col("v").alias("node"), F.col("b").alias("at")))).alias("x")).select("x.*").distinct(), "names")
    left = stored(first.select("a", "b").distinct(), "edges")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")), "step")
        renamed = stored(names.join(step, names["at"] == step["a"], "left").select("node", F.coalesce("to", "at").alias("at")), "names")
        one = left.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("y"))
        two = one.join(step, one["y"] == step["a"]).select("x", F.col("to").alias("y")).filter("x <> y")
        contracted = stored(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(names, left, step)
        names, left = renamed, contracted
    discard(left)
    return names.select("node", F.col("at").alias("root"))
