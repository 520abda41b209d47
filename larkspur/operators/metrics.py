"""Classification measures, score summaries, areas and regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.sources.storage import discard, stored

#: Ranges of values that are broadcast.
BROADCAST_RANGES = 10_000


def _share(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def accuracy_by_class(predictions: DataFrame, by: str) -> DataFrame:
    """Share of right predictions per group and class; null stands for all groups or all classes."""
    right = (F.col("pred") == F.col("truth")).cast("double")
    return predictions.rollup(by, "truth").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"))


def class_scores(predictions: DataFrame, by: str) -> DataFrame:
    """Precision, recall, F1 and support per group and class."""
    each = predictions.withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    hit, said, true = F.col("pred") == F.col("cls"), _count(F.col("pred") == F.col("cls")), _count(F.col("truth") == F.col("cls"))
    both = _count(hit & (F.col("truth") == F.col("cls")))
    scores = each.groupBy(by, "cls").agg(_share(both, said).alias("precision"), _share(both, true).alias("recall"), _share(2 * both, said + true).alias("f1"), true.alias("support"))
    return scores


def fscores(predictions: DataFrame, by: str, positive: int = 1) -> DataFrame:
    """F1 of the class ``positive`` and the mean over both classes."""
    each = class_scores(predictions, by)
    return each.groupBy(by).agg(F.max(F.when(F.col("cls") == positive, F.col("f1"))).alias("fscore"), F.avg("f1").alias("fscore_macro"))


def sign_counts(scores: DataFrame, by: str, score: str = "score", median: bool = True) -> DataFrame:
    """Numbers of positive and negative scores (zeros are neither), the positive share and, if asked, the exact median."""
    s = F.col(score)
    counts = scores.groupBy(by).agg(_count(s > 0).alias("n_pos"), _count(s < 0).alias("n_neg"), F.avg((s > 0).cast("double")).alias("pos_ratio"))
    if not median:
        return counts
    middle = exact_median(scores, by, score).withColumnRenamed(by, "by__")
    return counts.join(middle, counts[by].eqNullSafe(middle["by__"]), "left").drop("by__")


def exact_median(rows: DataFrame, by: str, value: str, cells: int = 256, small: int = 4_096) -> DataFrame:
    """``by, median`` of finite values, exactly, without any group in one task: the mean of the two middle ones of an even number.

    Each group has a range of values that holds the one looked for. A round counts the values in ``cells`` parts of the range, and the part with the
    wanted place becomes the next range, until it has one distinct value, or few; only values in the ranges are read on. Counts are combined
    before the shuffle, and ranges are broadcast only if they are few.
    """
    v = F.col(value).cast("double")
    finite = rows.select(F.col(by).alias("by__"), v.alias("v__")).filter("v__ IS NOT NULL AND NOT isnan(v__) AND abs(v__) < double('infinity')")
    first = finite.groupBy("by__").agg(F.count(F.lit(1)).alias("n"), F.min("v__").alias("low"), F.max("v__").alias("high"))
    places = F.explode(F.array_distinct(F.array(F.expr("(n + 1) DIV 2"), F.expr("n DIV 2 + 1")))).alias("place")
    ranges = stored(first.select("by__", places, "low", "high", F.lit(0).cast("long").alias("below"), "n"), "ranges")

    def within(open_: DataFrame) -> DataFrame:
        few = F.broadcast(open_) if open_.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else open_
        return finite.join(few.withColumnRenamed("by__", "of__"), F.col("by__").eqNullSafe(F.col("of__")) & (F.col("v__") >= F.col("low")) & (F.col("v__") <= F.col("high"))).drop("of__")

    wide = (F.col("low") < F.col("high")) & (F.col("n") > small)
    while ranges.filter(wide).limit(1).count():
        # Halves first, so that the width of a range is always a number.
        share = (F.col("v__") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
        counted = within(ranges.filter(wide)).groupBy("by__", "place", "below", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v__").alias("low"), F.max("v__").alias("high"))
        upto = F.sum("n").over(W.partitionBy("by__", "place").orderBy("cell"))  # a row per cell
        found = counted.withColumn("upto", F.col("below") + upto).filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        narrower = found.select("by__", "place", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "n")
        ranges, before = stored(ranges.filter(~wide).unionByName(narrower), "ranges"), ranges
        discard(before)
    rank = F.row_number().over(W.partitionBy("by__", "place").orderBy("v__"))  # few
    last = within(ranges.filter("low < high")).withColumn("rank", F.col("below") + rank).filter(F.col("rank") == F.col("place")).select("by__", F.col("v__").alias("middle"))
    return ranges.filter("low = high").select("by__", F.col("low").alias("middle")).unionByName(last).groupBy(F.col("by__").alias(by)).agg(F.avg("middle").alias("median"))


def trapezoid_area(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``area``: under the line through a group's points, over the range of ``x``; null for one point."""
    w = W.partitionBy(by).orderBy(x)
    steps = points.select(by, x, ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("part"))
    return steps.groupBy(by).agg((F.sum("part") / F.nullif(F.max(x) - F.min(x), F.lit(0))).alias("area"))


def line_fit(rows: DataFrame, x: str, y: str, *by: str, p_value: bool = False) -> DataFrame:
    """Slope, intercept and R² of least squares, 0 where undefined; if asked also ``p``, the two-sided probability of such a slope without any relation."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.regr_count(y, x)
    found = rows.groupBy(*by).agg(zero(F.regr_slope(y, x)).alias("slope"), zero(F.regr_intercept(y, x)).alias("intercept"), zero(F.regr_r2(y, x)).alias("r2"), n.alias("n"))
    if not p_value:
        return found.drop("n")
    chance = incomplete_beta((F.col("n") - 2) / F.lit(2.0), F.lit(0.5), F.greatest(F.lit(0.0), 1 - F.col("r2")))
    return found.withColumn("p", F.when(F.col("n") > 2, chance).otherwise(F.when(F.col("r2") > 0, 0.0).otherwise(1.0))).drop("n")


def log_gamma(x: Column) -> Column:
    """Of positive numbers, by Stirling's series eight steps further."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + series - steps


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that is short.

    With a = n/2, b = 1/2 and x = n/(n + t²) it is the two-sided tail of Student's distribution. Steps grow with the root of the larger parameter.
    """
    near = x < (a + 1) / (a + b + 2)
    p, q, z = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 / tiny(1 + even * s["d"])
        c = tiny(1 + even / s["c"])
        h = s["h"] * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d2 = 1 / tiny(1 + odd * d)
        c2 = tiny(1 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    start = 1 / tiny(1 - (p + q) * z / (p + 1))
    steps = F.sequence(F.lit(1), (F.lit(100) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    fraction = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h")), lambda s, m: step(s, m.cast("double")), lambda s: s["h"])
    front = F.exp(p * F.log(z) + q * F.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    side = F.when(z <= 0, F.lit(0.0)).otherwise(front * fraction)
    return F.when(near, side).otherwise(1 - side)


def residuals(rows: DataFrame, x: str, y: str) -> DataFrame:
    """With ``residual`` from the line through all rows."""
    return rows.crossJoin(F.broadcast(line_fit(rows, x, y))).withColumn("residual", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).drop("slope", "intercept", "r2")
