"""Genomic intervals: 0-based, half-open ``chrom, start, stop`` and any further columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.hashing import uniform
from larkspur.operators.relational import numbered

#: Positions of a bin: the unit in which a chromosome is cut for windows.
BIN = 1 << 16
#: Positions of a bin of the lowest level of range joins, about the length of a short region: neighbours that share a bin are all compared.
JOINED = 1 << 10
#: Points that one window runs over when they are smoothed.
RUN = 1 << 12


def center_regions(regions: DataFrame, window: int) -> DataFrame:
    """Windows of exactly ``window`` around the middles; other columns stay."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    return regions.withColumn("start", middle - window // 2).withColumn("stop", F.col("start") + window)


def center_windows(regions: DataFrame, window: int) -> DataFrame:
    """Windows of twice ``window // 2``, so an odd ``window`` gives one less; only places and strand stay."""
    middle, half = F.floor((F.col("start") + F.col("stop")) / 2), window // 2
    kept = [c for c in ("region_id", "chrom", "strand") if c in regions.columns]
    return regions.select(*kept, (middle - half).alias("start"), (middle + half).alias("stop"))


def region_name(chrom: Column, start: Column, stop: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def parsed_region(name: Column) -> list[Column]:
    parts = F.split(name, "[:-]")
    return [parts[0].alias("chrom"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("stop")]


def keep_chromosomes(regions: DataFrame, chroms: list[str]) -> DataFrame:
    return regions.filter(F.col("chrom").isin(chroms))


def keep_frequent(rows: DataFrame, by: str, least: int) -> DataFrame:
    """Rows of groups of at least ``least`` rows. Counts are combined before the shuffle, rows are not gathered."""
    enough = rows.groupBy(by).count().filter(F.col("count") >= least).select(by)
    return rows.join(enough, by, "left_semi")


def reach_before(regions: DataFrame, *tie: str) -> DataFrame:
    """With ``reach``, the largest ``stop`` of the regions before this one by ``start`` and ``tie``; null for none.

    Bins carry their largest ``stop`` forward, and a window runs within a bin only: no task holds a
    chromosome.
    """
    binned = regions.withColumn("bin", F.floor(F.col("start") / BIN))
    before = W.partitionBy("chrom").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    carried = binned.groupBy("chrom", "bin").agg(F.max("stop").alias("last")).select("chrom", "bin", F.max("last").over(before).alias("carried"))
    within = W.partitionBy("chrom", "bin").orderBy("start", *tie).rowsBetween(W.unboundedPreceding, -1)
    return binned.join(carried, ["chrom", "bin"]).withColumn("reach", F.greatest(F.max("stop").over(within), F.col("carried"))).drop("carried")


def merge_overlaps(regions: DataFrame, *tie: str) -> DataFrame:
    """``chrom, start, stop, n``: blocks of regions that overlap; those that only touch stay apart."""
    return with_block(regions, *tie).groupBy("chrom", "block").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n")).drop("block")


def with_block(regions: DataFrame, *tie: str) -> DataFrame:
    """With ``block``, the start of the block of overlapping regions that a region belongs to."""
    marked = reach_before(regions, *tie).withColumn("head", F.when(F.col("reach").isNull() | (F.col("reach") <= F.col("start")), F.col("start")))
    before = W.partitionBy("chrom").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    carried = marked.groupBy("chrom", "bin").agg(F.max("head").alias("last")).select("chrom", "bin", F.max("last").over(before).alias("carried"))
    within = W.partitionBy("chrom", "bin").orderBy("start", *tie).rowsBetween(W.unboundedPreceding, 0)
    return marked.join(carried, ["chrom", "bin"]).withColumn("block", F.coalesce(F.max("head").over(within), F.col("carried"))).drop("head", "carried", "reach", "bin")


def first_wins(regions: DataFrame, *tie: str) -> DataFrame:
    """What of each region no earlier one covers: where regions overlap, bases belong to the first by
    start and ``tie``. Regions of negative start are left out, regions that lose all their bases too."""
    own = reach_before(regions.filter("start >= 0"), *tie)
    return own.withColumn("start", F.greatest("start", F.coalesce("reach", "start"))).filter("start < stop").drop("reach", "bin")


def moving_average(points: DataFrame, width: int = 10) -> DataFrame:
    """``smooth``: the sum of ``width`` neighbouring values in a block over ``width``, zeros beyond its ends.

    Points are numbered within their block and cut into runs of ``RUN``; the few at a border are copied to the run beyond it, so
    a window holds a run, however long the block.
    """
    before, after = width // 2, width - width // 2 - 1
    if width > RUN:
        raise ValueError(f"windows have at most {RUN} points")
    own, at = F.floor(F.col("ordinal") / RUN), F.col("ordinal") % RUN
    runs = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= RUN - before, own + 1)))
    copied = numbered(points, "start", by=["chrom", "block"]).withColumn("run", F.explode(runs))
    frame = W.partitionBy("chrom", "block", "run").orderBy("ordinal").rowsBetween(-before, after)
    return copied.withColumn("smooth", F.sum("value").over(frame) / width).filter(F.col("run") == own).drop("run", "ordinal")


def level_of(length: Column) -> Column:
    """The level whose bins are at least as long as an interval: bins of level k have ``JOINED * 8**k`` positions."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1)).cast("double") / JOINED) / math.log(8.0) - 1e-9)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / (JOINED * F.pow(F.lit(8.0), level))).cast("long")


def _own_bins(rows: DataFrame, start: str, stop: str, level: str) -> DataFrame:
    """A row for each bin of its own level that an interval touches: one or two, however long it is."""
    return rows.withColumn("bin", F.explode(F.sequence(_bin(F.col(start), F.col(level)), _bin(F.col(stop) - 1, F.col(level)))))


def _levels(rows: DataFrame, level: str) -> list[int]:
    """Levels that occur, of which a genome has a handful."""
    return sorted(r[0] for r in rows.select(level).distinct().collect())


def track_values(regions: DataFrame, signal: DataFrame) -> DataFrame:
    """Regions with ``track``, a value per base, from ``signal(chrom, start, stop, value)`` of intervals that don't overlap;
    0 where there is none.

    Intervals meet regions by equi-joins on bins of the longer one's level, in which it has one or two rows, so a region of a whole chromosome makes no more rows than a
    short one. A pair that has two bins in common meets in that of its later start. What is gathered for a region lies within it.
    """
    left = regions.filter("start < stop").withColumn("level", level_of(F.col("stop") - F.col("start")))
    right = signal.filter("start < stop").select("chrom", F.col("start").alias("from"), F.col("stop").alias("to"), "value").withColumn("of_level", level_of(F.col("to") - F.col("from")))
    own, other = _levels(left, "level"), _levels(right, "of_level")
    upwards = lambda rows, level, levels, least: rows.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k > F.col(level) - least)))
    longer = _own_bins(left, "start", "stop", "level").withColumnRenamed("level", "at").join(_own_bins(upwards(right, "of_level", own, 1), "from", "to", "at").drop("of_level"), ["chrom", "at", "bin"])
    shorter = _own_bins(upwards(left, "level", other, 0), "start", "stop", "at").drop("level").join(_own_bins(right, "from", "to", "of_level").withColumnRenamed("of_level", "at"), ["chrom", "at", "bin"])
    met = longer.unionByName(shorter).filter((F.col("from") < F.col("stop")) & (F.col("to") > F.col("start")) & (F.col("bin") == _bin(F.greatest("from", "start"), F.col("at"))))
    piece = F.struct(F.greatest("from", "start").alias("a"), F.least("to", "stop").alias("b"), F.col("value").cast("double").alias("v"))
    each = met.select(*regions.columns, piece.alias("piece")).unionByName(left.select(*regions.columns, F.lit(None).cast("struct<a:long,b:long,v:double>").alias("piece")))
    pieces = each.groupBy(*regions.columns).agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    ends = F.concat(F.array("start"), F.transform("pieces", lambda p: p["b"]))
    each_one = lambda p, end: F.concat(zeros(p["a"] - end), F.array_repeat(p["v"], (p["b"] - p["a"]).cast("int")))
    walked = F.flatten(F.zip_with("pieces", F.slice("ends", F.lit(1), F.size("pieces")), each_one))
    return pieces.withColumn("ends", ends).select(*regions.columns, F.concat(walked, zeros(F.col("stop") - F.element_at("ends", -1))).alias("track"))


def range_join(regions: DataFrame, points: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """Regions with the ``pos, value`` they contain, by an equi-join on bins of each region's level.

    A region has one or two rows, whatever its length, and a point one for each of ``levels``, those that occur among the regions if none are given.
    """
    left = regions.filter("start < stop").withColumn("level", level_of(F.col("stop") - F.col("start")))
    levels = _levels(left, "level") if levels is None else levels
    right = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", _bin(F.col("pos"), F.col("level")))
    return _own_bins(left, "start", "stop", "level").join(right, ["chrom", "level", "bin"]).filter("pos >= start AND pos < stop").drop("level", "bin")


def random_regions(sizes: DataFrame, window: int, n: int, seed: str) -> DataFrame:
    """``region_id, chrom, start, stop``: windows placed evenly over all places that hold one.

    ``sizes(chrom, length)`` has one row per chromosome; it is broadcast, as genomes have bounded numbers of them.
    """
    room = sizes.filter(F.col("length") >= window).withColumn("room", F.col("length") - window + 1)
    upto = room.withColumn("upto", F.sum("room").over(W.orderBy("chrom")))
    upto = upto.withColumn("from", F.col("upto") - F.col("room")).withColumn("all", F.sum("room").over(W.partitionBy()))
    draws = sizes.sparkSession.range(n).select(F.col("id").alias("region_id"), uniform(seed, "region", F.col("id")).alias("u"))
    at = F.floor(F.col("u") * F.col("all"))
    return draws.join(F.broadcast(upto), (at >= F.col("from")) & (at < F.col("upto"))).select("region_id", "chrom", (at - F.col("from")).alias("start"), (at - F.col("from") + window).alias("stop"))


def position_bins(window: int, bins: int) -> list[tuple[int, int]]:
    """Buffers on both sides that leave each of ``bins`` equal parts of a window."""
    edges = [int(window * i / bins) for i in range(bins + 1)]
    return [(a, window - b) for a, b in zip(edges, edges[1:])]


def edge_bins(edges: DataFrame, window: int) -> DataFrame:
    """The same from a table of ``edge``s: ``start_buffer, end_buffer`` of consecutive ones."""
    following = F.lead("edge").over(W.orderBy("edge"))  # a handful of parameters
    return edges.select(F.col("edge").alias("start_buffer"), (F.lit(window) - following).alias("end_buffer")).filter("end_buffer IS NOT NULL")
