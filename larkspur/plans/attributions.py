"""Attributions of regions' sequences against random baselines, at a layer or at the letters, as tables and files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import attribution as A
from larkspur.operators import pca
from larkspur.operators.intervals import region_name
from larkspur.operators.relational import cycled, numbered, repeated
from larkspur.sources import files
from larkspur.sources.storage import stored


def with_baselines(targets: DataFrame, pool: DataFrame, each: int, value: str) -> DataFrame:
    """``id, k`` with ``value`` of each target and ``base`` of ``each`` rows of the pool, taken in turn."""
    turns = repeated(numbered(targets.select("id", value), "id"), each).withColumn("ordinal", F.col("ordinal") * each + F.col("k"))
    others = numbered(pool.select(F.col("id").alias("of"), F.col(value).alias("base")), "of").drop("of")
    return cycled(turns, others).select("id", "k", value, "base")


def mean_arrays(rows: DataFrame, by: str, array: str, *numbers: str) -> DataFrame:
    """The mean of each place of the arrays of a key, which has a few rows, and of other numbers."""
    total = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    grouped = rows.groupBy(by).agg(F.collect_list(array).alias("all"), *[F.avg(c).alias(c) for c in numbers])
    return grouped.select(by, F.transform(total, lambda v: v / F.size("all")).alias(array), *numbers)


def save_model(spark: SparkSession, model: pca.Model, path: str) -> None:
    """The few matrices of a model as one line of JSON."""
    spark.createDataFrame([(json.dumps({k: v.tolist() for k, v in model._asdict().items()}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> pca.Model:
    held = json.loads(spark.read.text(path).first().value)
    found = pca.Model(**{k: np.array(v, float) for k, v in held.items()})
    return found._replace(components=found.components.reshape(-1, len(found.mean)))


def layer_run(targets: DataFrame, pool: DataFrame, layers: list[A.Layer], upto: int, model: pca.Model, each: int = 10, times_difference: bool = True) -> dict[str, DataFrame]:
    """Of ``id, seq``: ``embeddings``, ``attributions`` at the output of the first ``upto`` layers (means over ``each`` baselines of the pool) and ``predictions``."""
    own, other = (stored(A.layer_output(x, layers, upto), "outputs") for x in (targets, pool))
    pairs = with_baselines(own, other, each, "vector").withColumn("pair", F.monotonically_increasing_id())
    pairs = stored(pairs.select("pair", "id", "vector", "base"), "pairs")
    found = A.layer_attributions(pairs.select(F.col("pair").alias("id"), "vector", "base"), layers[upto:], model, times_difference=times_difference)
    attributions = mean_arrays(found.withColumnRenamed("id", "pair").join(pairs.select("pair", "id"), "pair"), "id", "a")
    embedded = pca.embed(own, model)
    return {"embeddings": embedded, "attributions": attributions, "predictions": A.patched_output(embedded, layers, upto, model)}


def input_run(targets: DataFrame, pool: DataFrame, layers: list[A.Layer], upto: int, model: pca.Model, basis: np.ndarray, each: int = 10) -> DataFrame:
    """Of ``id, seq``: ``id, total, inside, outside`` (a number per letter each, means over ``each`` baselines) and ``difference`` of the outputs.

    ``inside`` is what passes through the span of ``basis`` at the output of the first ``upto`` layers, ``outside`` the rest.
    """
    pairs = with_baselines(targets.select("id", "seq"), pool.select("id", "seq"), each, "seq").withColumn("pair", F.monotonically_increasing_id())
    pairs = stored(pairs.select("pair", "id", "seq", "base"), "pairs")
    found = pairs.select("id").distinct()
    for name, part in (("total", "all"), ("inside", "inside"), ("outside", "outside")):
        each_pair = A.input_attributions(pairs.select(F.col("pair").alias("id"), "seq", "base"), layers, upto, model, basis, part).withColumnRenamed("id", "pair")
        means = mean_arrays(each_pair.join(pairs.select("pair", "id"), "pair"), "id", "a", "difference").withColumnRenamed("a", name)
        found = found.join(means if part == "all" else means.drop("difference"), "id")
    return found


def region_table(regions: DataFrame, found: DataFrame) -> DataFrame:
    """``region, total, inside, outside``: sums over letters, most of what passes through the span first."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(c)
    sums = found.select("id", *map(total, ("total", "inside", "outside")))
    named = regions.select("id", region_name(F.col("chrom"), F.col("start"), F.col("stop")).alias("region"))
    return named.join(sums, "id").drop("id").orderBy(F.desc("inside"), "region")


def write_inputs(regions: DataFrame, found: DataFrame, path: str, sizes: DataFrame | None = None) -> None:
    """A table of regions and, for each kind of attribution, a bigWig folder of the letters'."""
    files.write_tsv(region_table(regions, found), f"{path}/regions")
    found.write.mode("overwrite").parquet(f"{path}/letters")
    for name in ("total", "inside", "outside"):
        arrays = regions.join(found.select("id", name), "id").withColumnRenamed("id", "region_id")
        files.write_signal(arrays, name, f"{path}/{name}", kind="bigwig", sizes=sizes)
