"""Vectors in long form ``(id, d, v)``: statistics, standardisation, centroids, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(rows: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Rows whose vector takes part: neither null nor with null or non-finite components, and of the given length, or that which most such vectors have."""
    whole = rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if size is not None:
        return whole.filter(F.size(vector) == size)
    most = whole.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.filter(F.size(vector) == (most.n if most else 0))


def long_form(vectors: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row per component, in double precision; null vectors give none."""
    return vectors.select(*keys, F.posexplode(vector).alias("d", "v")).withColumn("v", F.col("v").cast("double"))


def zscore_stats(long: DataFrame) -> DataFrame:
    """Mean and sample deviation per dimension; a deviation of 0 becomes -1, so that z is 0."""
    stats = long.groupBy("d").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") == 0, F.lit(-1.0)).otherwise(F.col("std")))


def standardised(long: DataFrame, stats: DataFrame) -> DataFrame:
    """``z = (v - mean) / std``; the statistics have one row per dimension of a vector."""
    return long.join(F.broadcast(stats), "d").withColumn("z", (F.col("v") - F.col("mean")) / F.col("std"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 where undefined."""
    return F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).cast("double")


def log_ratio(pos: Column, neg: Column, pseudo: float = 1.0) -> Column:
    """Natural logarithm of the ratio of two counts, each with a pseudo-count."""
    return F.log((pos + F.lit(pseudo)) / (neg + F.lit(pseudo)))
