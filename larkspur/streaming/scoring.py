"""Scores of a stream of attributions against fixed concept directions. An extension: files in, counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.vectors import log_ratio


def sign_stream(attributions: DataFrame, cavs: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """``window, concept, n_pos, n_neg, log_ratio`` of a stream ``ts, id, a``; ``cavs(concept, w)`` is static.

    The directions, a row per concept, are broadcast; late rows beyond ``delay`` are dropped by the watermark.
    """
    marked = attributions.withWatermark("ts", delay)
    found = marked.crossJoin(F.broadcast(cavs.select("concept", "w"))).select("ts", "concept", F.aggregate(F.zip_with("a", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))
    counts = found.groupBy(F.window("ts", window).alias("window"), "concept").agg(F.sum((F.col("score") > 0).cast("long")).alias("n_pos"), F.sum((F.col("score") < 0).cast("long")).alias("n_neg"))
    return counts.withColumn("log_ratio", log_ratio(F.col("n_pos"), F.col("n_neg")))


