"""Pairing, numbering, overlaying and sampling of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.hashing import shuffle_key
from larkspur.sources.storage import stored

def left_joined(tables: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda left, right: left.join(right, on, "left"), tables)


def same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An equi-join in which nulls are equal; ``on`` has the columns of both, kept once."""
    other = right.withColumnsRenamed({c: f"{c}__right" for c in on})
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__right")) for c in on])
    return left.join(other, met).drop(*[f"{c}__right" for c in on])


def numbered(rows: DataFrame, key: str, *tie: str, by: Sequence[str] = ()) -> DataFrame:
    """With ``ordinal`` from 0 in the order of ``key`` and ``tie``, in each group of ``by`` if given.

    Rows are cut by quantiles of the key into as many ranges as there are shuffle partitions, and stored; ranges carry
    their counts forward and rows are numbered within a range, so no task sorts the table or a whole group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, key, *tie).withColumn("range__", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*by).orderBy("range__").rowsBetween(W.unboundedPreceding, -1)  # a row per range and group
    offsets = ranged.groupBy(*by, "range__").count().select(*by, "range__", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset__"))
    within = F.row_number().over(W.partitionBy(*by, "range__").orderBy(key, *tie)) - 1
    return same(ranged.withColumn("within__", within), offsets, [*by, "range__"]).withColumn("ordinal", (F.col("offset__") + F.col("within__")).cast("long")).drop("range__", "offset__", "within__")


def running_sum(rows: DataFrame, key: str, value: str, *tie: str) -> DataFrame:
    """With ``upto``, the sum of ``value`` of all rows up to this one in the order of ``key`` and ``tie``; ranges carry their sums forward."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, key, *tie).withColumn("range__", F.spark_partition_id()), "ranges")
    before = W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("range__").agg(F.sum(value).alias("sum__")).select("range__", F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"))
    within = F.sum(value).over(W.partitionBy("range__").orderBy(key, *tie).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("within__", within).join(offsets, "range__").withColumn("upto", F.col("offset__") + F.col("within__")).drop("range__", "offset__", "within__")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Numbered rows in pairs; the shorter side ends it."""
    return left.join(right, "ordinal")


def cycled(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every numbered row of ``left`` with one of ``right``, which starts over when it ends."""
    n = right.agg(F.count(F.lit(1)).alias("n"))
    turned = left.crossJoin(F.broadcast(n)).withColumn("turn", F.col("ordinal") % F.col("n")).drop("n")
    return turned.join(right.withColumnRenamed("ordinal", "turn"), "turn")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times with ``k`` from 0."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def first_of_union(tables: list[DataFrame], by: str, latest: bool = False) -> DataFrame:
    """One row per key from several tables: of the first (or ``latest``) table that has it, with its place ``src``."""
    stacked = reduce(lambda a, b: a.unionByName(b), [t.withColumn("src", F.lit(i)) for i, t in enumerate(tables)])
    order = F.desc("src") if latest else F.asc("src")
    return stacked.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(order))).filter("nth = 1").drop("nth")


def first_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("nth") <= n)


def first_batches(rows: DataFrame, by: str, order: str, n: int, batch: int) -> DataFrame:
    """The first rows of each group in whole batches: as many batches as hold ``n``."""
    return first_n(rows, by, order, -(-n // batch) * batch)


def whole_batches(rows: DataFrame, size: int) -> DataFrame:
    """Numbered rows with ``batch``, without the last one if it isn't full."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    batched = rows.crossJoin(F.broadcast(n)).withColumn("batch", F.floor(F.col("ordinal") / size))
    return batched.filter(F.col("ordinal") < F.floor(F.col("n") / size) * size).drop("n")


def split_by_hash(rows: DataFrame, by: str, key: Column, test_share: float, seed: str) -> DataFrame:
    """With ``split``: of each class, the first share in hash order is ``test``, rounded up, the rest ``train``."""
    keyed = rows.withColumns({"hash__": shuffle_key(seed, key), "key__": key})
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size__"))
    placed = same(numbered(keyed, "hash__", "key__", by=[by]), sizes, [by])
    split = F.when(F.col("ordinal") < F.ceil(F.col("size__") * test_share), "test").otherwise("train")
    return placed.withColumn("split", split).drop("hash__", "key__", "size__", "ordinal")


def epochs(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """``n`` epochs of all rows: ``epoch`` from 0, and ``turn``, a hash that gives each epoch an order of its own."""
    return repeated(rows, n).withColumnRenamed("k", "epoch").withColumn("turn", shuffle_key(seed, F.col("epoch"), F.col(key)))


def sampled(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, in hash order."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)
