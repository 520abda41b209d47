"""Interval operators over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.hashing import uniform_sql
from larkspur.operators import intervals as I
from larkspur.plans import proxies as P

WINDOW, CHROMS, LEAST = 200, ["chr1", "chr3"], 50


def b1_center_regions(spark, sf_dir):
    return I.center_regions(P.regions(spark, sf_dir), WINDOW)


def b2_center_windows_odd(spark, sf_dir):
    return I.center_windows(P.regions(spark, sf_dir), 101)


def b17_region_strings(spark, sf_dir):
    named = P.regions(spark, sf_dir).select("region_id", I.region_name(F.col("chrom"), F.col("start"), F.col("stop")).alias("name"))
    return named.select("region_id", "name", *I.parsed_region(F.col("name")))


def f1_chrom_filter(spark, sf_dir):
    return I.keep_chromosomes(P.regions(spark, sf_dir), CHROMS)


def f4_min_samples(spark, sf_dir):
    return I.keep_frequent(P.regions(spark, sf_dir), "concept", LEAST).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


def f5_interval_merge(spark, sf_dir):
    return I.merge_overlaps(P.regions(spark, sf_dir), "region_id")


def a23_first_wins(spark, sf_dir):
    return I.first_wins(P.regions(spark, sf_dir), "region_id").select("region_id", "chrom", "start", "stop")


def f6_moving_average(spark, sf_dir):
    points = P.signal(spark, sf_dir).groupBy("chrom", F.col("pos").alias("start")).agg(F.sum("value").alias("value")).withColumn("stop", F.col("start") + 30)
    smooth = I.moving_average(I.with_block(points))
    return smooth.select("chrom", F.col("start").alias("pos"), F.round("smooth", 6).alias("smooth"))


def f3_position_bins(spark, sf_dir):
    width = P.sequences(spark, sf_dir).agg(F.max(F.length("seq")).alias("w")).first().w
    return I.edge_bins(spark.createDataFrame([(width * i // 5,) for i in range(6)], "edge long"), width)


def d6_range_join(spark, sf_dir):
    points = P.table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("chrom"), (F.col("event_id").cast("long") * 97).alias("pos"), F.col("value").cast("double").alias("value"))
    return I.range_join(P.regions(spark, sf_dir), points).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def a6_chrom_sizes(spark, sf_dir):
    return P.regions(spark, sf_dir).groupBy("chrom").agg(F.max("stop").alias("length"))


def a19_random_regions(spark, sf_dir):
    return I.random_regions(a6_chrom_sizes(spark, sf_dir), WINDOW, 1000, "7")


def e2_track_mean_std(spark, sf_dir):
    """Mean and population deviation over bases: regions weighted by their lengths."""
    rows = P.regions(spark, sf_dir).withColumn("n", (F.col("stop") - F.col("start")).cast("double")).withColumn("v", (F.col("region_id") % 17).cast("double"))
    sums = rows.groupBy("chrom").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("chrom", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - mean * mean), 6).alias("std"))


def a9_region_signal(spark, sf_dir):
    """Values under each region in the order of positions, as one text."""
    points = P.table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("chrom"), (F.col("event_id").cast("long") * 97).alias("pos"), (F.col("event_id") % 10).alias("value"))
    joined = I.range_join(P.regions(spark, sf_dir), points).groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return joined.select("region_id", F.array_join(F.transform("x", lambda x: x["value"].cast("string")), ",").alias("track"))


REACH = "r AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)"
POINTS = "pts AS (SELECT concat('chr', user_id % 5 + 1) AS chrom, event_id::BIGINT * 97 AS pos, value::DOUBLE AS value, event_id % 10 AS digit FROM events)"

ORACLE_SQL = {
    "b1_center_regions": f"WITH {P.REGIONS} SELECT region_id, chrom, (start + stop) // 2 - 100 AS start, (start + stop) // 2 + 100 AS stop, strand, concept FROM iv",
    "b2_center_windows_odd": f"WITH {P.REGIONS} SELECT region_id, chrom, strand, (start + stop) // 2 - 50 AS start, (start + stop) // 2 + 50 AS stop FROM iv",
    "b17_region_strings": f"WITH {P.REGIONS} SELECT region_id, chrom || ':' || start || '-' || stop AS name, chrom, start, stop FROM iv",
    "f1_chrom_filter": f"WITH {P.REGIONS} SELECT * FROM iv WHERE chrom IN ('chr1', 'chr3')",
    "f4_min_samples": f"WITH {P.REGIONS} SELECT concept, count(*) AS n FROM iv GROUP BY concept HAVING count(*) >= {LEAST}",
    "f5_interval_merge": f"WITH {P.REGIONS}, {REACH}, b AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach <= start THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, region_id) AS block FROM r) SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM b GROUP BY chrom, block",
    "a23_first_wins": f"WITH {P.REGIONS}, {REACH} SELECT region_id, chrom, greatest(start, coalesce(reach, start)) AS start, stop FROM r WHERE start >= 0 AND greatest(start, coalesce(reach, start)) < stop",
    "f6_moving_average": f"""WITH {P.SIGNAL}, p AS (SELECT chrom, pos, sum(value) AS value FROM sig GROUP BY chrom, pos),
      g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) < 30 THEN 0 ELSE 1 END AS head FROM p),
      b AS (SELECT *, sum(head) OVER (PARTITION BY chrom ORDER BY pos) AS block FROM g)
      SELECT chrom, pos, round(sum(value) OVER (PARTITION BY chrom, block ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth FROM b""",
    "f3_position_bins": f"WITH {P.SEQUENCES}, w AS (SELECT max(length(seq)) AS w FROM seqs), e AS (SELECT w, floor(w * i / 5)::BIGINT AS edge FROM w, generate_series(0, 5) s(i)), l AS (SELECT w, edge, lead(edge) OVER (ORDER BY edge) AS after FROM e) SELECT edge AS start_buffer, w - after AS end_buffer FROM l WHERE after IS NOT NULL",
    "d6_range_join": f"WITH {P.REGIONS}, {POINTS} SELECT region_id, count(*) AS n, round(sum(value), 6) AS total FROM iv JOIN pts ON iv.chrom = pts.chrom AND pos >= start AND pos < stop GROUP BY region_id",
    "a6_chrom_sizes": f"WITH {P.REGIONS} SELECT chrom, max(stop) AS length FROM iv GROUP BY chrom",
    "a19_random_regions": f"""WITH {P.REGIONS}, s AS (SELECT chrom, max(stop) - {WINDOW} + 1 AS room FROM iv GROUP BY chrom), u AS (SELECT chrom, room, (sum(room) OVER (ORDER BY chrom))::BIGINT AS upto, (sum(room) OVER ())::BIGINT AS every FROM s),
      d AS (SELECT i AS region_id, {uniform_sql("'7'", "'region'", "i::VARCHAR")} AS u FROM generate_series(0, 999) s(i)),
      j AS (SELECT region_id, chrom, floor(d.u * every)::BIGINT - (upto - room) AS start FROM d JOIN u ON floor(d.u * every) >= upto - room AND floor(d.u * every) < upto) SELECT region_id, chrom, start, start + {WINDOW} AS stop FROM j""",
    "e2_track_mean_std": f"WITH {P.REGIONS}, x AS (SELECT chrom, (stop - start)::DOUBLE AS n, (region_id % 17)::DOUBLE AS v FROM iv) SELECT chrom, round(sum(n * v) / sum(n), 6) AS mean, round(sqrt(sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) * (sum(n * v) / sum(n))), 6) AS std FROM x GROUP BY chrom",
    "a9_region_signal": f"WITH {P.REGIONS}, {POINTS} SELECT region_id, string_agg(digit::VARCHAR, ',' ORDER BY pos, digit) AS track FROM iv JOIN pts ON iv.chrom = pts.chrom AND pos >= start AND pos < stop GROUP BY region_id",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
