"""Readers and writers over files made from the test tables, and operators on tracks and epochs."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.operators import intervals as I
from larkspur.operators import relational as R
from larkspur.plans import proxies as P
from larkspur.sources import bigwig, files
from larkspur.sources.storage import shared_dir, table


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _places(spark, sf_dir):
    return P.regions(spark, sf_dir).select("chrom", "start", "stop")


def a1_centred_bed(spark, sf_dir):
    path = _path(spark, "bed")
    files.write_tsv(_places(spark, sf_dir), path)
    return I.center_regions(files.read_tsv(spark, path, files.BED3), 200)


def a2_bed_scan(spark, sf_dir):
    path = _path(spark, "bed")
    files.write_tsv(P.regions(spark, sf_dir).select("chrom", "start", "stop", "strand", "concept"), path)
    return files.read_tsv(spark, path, files.BED5)


def a4_region_list(spark, sf_dir):
    path = _path(spark, "names")
    files.write_tsv(_places(spark, sf_dir).select(I.region_name(F.col("chrom"), F.col("start"), F.col("stop")).alias("name")), path)
    return files.read_tsv(spark, path, "name string").select(*I.parsed_region(F.col("name")))


def a5_narrow_peak(spark, sf_dir):
    path = _path(spark, "peaks")
    rows = P.regions(spark, sf_dir).select("chrom", "start", "stop", F.lit("."), (F.col("region_id") % 1000).cast("int"), F.lit("."), F.lit(1.5), F.lit(-1.0), F.lit(2.25), F.lit(100))
    files.write_tsv(rows.toDF("chrom", "start", "stop", "name", "score", "strand", "signal", "p", "q", "summit"), path)
    return files.read_tsv(spark, path, files.NARROW_PEAK)


def a6_fai_sizes(spark, sf_dir):
    path = _path(spark, "fai")
    sizes = P.regions(spark, sf_dir).groupBy("chrom").agg(F.max("stop").alias("length"))
    files.write_tsv(sizes.select("chrom", "length", F.lit(6), F.lit(60), F.lit(61)), path)
    return files.read_chrom_sizes(spark, path)


def a8_fasta_records(spark, sf_dir):
    path = _path(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    P.sequences(spark, sf_dir).filter("seq <> ''").select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit(" text\n"), lines).alias("value")).write.text(path)
    return files.read_fasta_windows(spark, path).select(F.col("name").cast("long").alias("seq_id"), F.md5("seq").alias("seq_md5"))


def a9_interval_tracks(spark, sf_dir):
    """Values per base under each region, from intervals of signal."""
    return _track_digests(I.track_values(P.regions(spark, sf_dir).select("region_id", "chrom", "start", "stop"), _event_signal(spark, sf_dir)))


def _event_signal(spark, sf_dir):
    at = F.col("event_id").cast("long") * 97
    return table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("chrom"), at.alias("start"), (at + 40).alias("stop"), (F.col("event_id") % 10).alias("value"))


def _track_digests(tracks):
    return tracks.select("region_id", F.size("track").alias("n"), F.md5(F.array_join(F.col("track").cast("array<int>").cast("array<string>"), ",")).alias("track_md5"))


def a9_bigwig_scan(spark, sf_dir):
    """The same tracks from intervals that were written as bigWig files and scanned."""
    path = _path(spark, "bigwig")
    bigwig.write_bigwig(_event_signal(spark, sf_dir), path)
    regions = P.regions(spark, sf_dir).select("region_id", "chrom", "start", "stop")
    return _track_digests(I.track_values(regions, bigwig.read_bigwig(spark, path)))


def a9_bigwig_regions(spark, sf_dir):
    """The same tracks by region: each finds its blocks in the files' indexes."""
    path = _path(spark, "bigwig")
    bigwig.write_bigwig(_event_signal(spark, sf_dir), path)
    return _track_digests(bigwig.tracks(P.regions(spark, sf_dir).select("region_id", "chrom", "start", "stop"), path))


def _fives(batches):
    """Regions with ``x``: a value per base that changes every five bases and repeats after 35; a region begins at its own five."""
    for batch in (b.slice(i, 1_024) for b in batches for i in range(0, b.num_rows, 1_024)):
        sizes = batch.column("stop").to_numpy() - batch.column("start").to_numpy()
        turns = np.tile(np.repeat(np.arange(7.0), 5), int(sizes.max()) // 35 + 2)
        first = batch.column("region_id").to_numpy() % 7 * 5
        x = np.concatenate([turns[a : a + n] for a, n in zip(first.tolist(), sizes.tolist())])
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chrom", "start", "stop", "region_id")), pa.ListArray.from_arrays(ends, pa.array(x))], names=["chrom", "start", "stop", "region_id", "x"])


def _signal_sums(spark, sf_dir, smooth):
    """Arrays of regions written as bigWig and scanned: bases, values and places by chromosome; smoothed values are tenths."""
    path = _path(spark, "signal")
    regions = P.regions(spark, sf_dir).select("region_id", "chrom", "start", "stop").filter("start >= 0 AND start < stop").repartition(8 * spark.sparkContext.defaultParallelism)
    files.write_signal(regions.mapInArrow(_fives, f"{files.BED3}, region_id long, x array<double>"), "x", path, smooth, kind="bigwig")
    n = F.col("stop") - F.col("start")
    v = F.rint(F.col("value").cast("double") * (10 if smooth else 1)).cast("long")
    moments = bigwig.read_bigwig(spark, path).select("chrom", n.alias("n"), (n * v).alias("total"), (v * F.expr("(start + stop - 1) * (stop - start) DIV 2")).alias("m"))
    # Sums of moments pass 64 bits on large genomes; those of their halves don't.
    sums = moments.groupBy("chrom").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.expr("sum(m DIV 4294967296)").alias("high"), F.expr("sum(m % 4294967296)").alias("low"))
    return sums.select("chrom", "n", "total", F.expr("CAST(CAST(high AS DECIMAL(20)) * 4294967296 + CAST(low AS DECIMAL(20)) AS DOUBLE)").alias("moment"))


def a23_bigwig_signal(spark, sf_dir):
    return _signal_sums(spark, sf_dir, False)


def a23_bigwig_smooth(spark, sf_dir):
    return _signal_sums(spark, sf_dir, True)


def a7_fasta_regions(spark, sf_dir):
    """Stretches of 20 letters of every sequence, on a strand, by ranges of bytes from FASTA files that are indexed first."""
    path = _path(spark, "fasta")
    seqs = P.sequences(spark, sf_dir).filter("length(seq) >= 20").withColumn("chrom", F.col("seq_id").cast("string"))
    seqs.select(F.concat(F.lit(">"), "chrom", F.lit(" text\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value")).write.text(path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 20, F.lit(50).cast("long")))
    regions = seqs.select("chrom", starts.alias("start")).withColumn("stop", F.col("start") + 20)
    regions = regions.withColumn("strand", F.when(F.col("start") / 50 % 2 < 1, "+").otherwise("-"))
    return files.read_fasta_regions(regions, files.index_fasta(spark, path)).select("chrom", "start", "strand", "seq")


def a15_prediction_files(spark, sf_dir):
    path = _path(spark, "predictions")
    rows = P.predictions(spark, sf_dir).select("concept", F.col("source").alias("control"), "pred", "truth")
    files.write_prediction_folders(rows, path)
    return files.read_prediction_folders(spark, f"{path}/*").groupBy("concept", "control").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("truth")).cast("long")).alias("n_right"))


def c10_epochs(spark, sf_dir):
    return R.epochs(table(spark, sf_dir, "documents").select("doc_id"), 3, "doc_id", "11")


#: The value of every base: that of the first region by place.
BASES = """bases AS (SELECT region_id, chrom, start, unnest(generate_series(start, stop - 1)) AS pos FROM iv),
  own AS (SELECT chrom, pos, arg_min(region_id, (start, region_id)) AS region_id, arg_min((region_id + (pos - start) // 5) % 7, (start, region_id)) AS v FROM bases GROUP BY chrom, pos)"""
ORACLE_SQL = {
    "a1_centred_bed": f"WITH {P.REGIONS} SELECT chrom, (start + stop) // 2 - 100 AS start, (start + stop) // 2 + 100 AS stop FROM iv",
    "a2_bed_scan": f"WITH {P.REGIONS} SELECT chrom, start, stop, strand, concept FROM iv",
    "a4_region_list": f"WITH {P.REGIONS} SELECT chrom, start, stop FROM iv",
    "a5_narrow_peak": f"WITH {P.REGIONS} SELECT chrom, start, stop, '.' AS name, (region_id % 1000)::INT AS score, '.' AS strand, 1.5::DOUBLE AS signal, (-1)::DOUBLE AS p, 2.25::DOUBLE AS q, 100::INT AS summit FROM iv",
    "a6_fai_sizes": f"WITH {P.REGIONS} SELECT chrom, max(stop) AS length FROM iv GROUP BY chrom",
    "a8_fasta_records": f"WITH {P.SEQUENCES} SELECT seq_id, md5(seq) AS seq_md5 FROM seqs WHERE seq <> ''",
    "a9_interval_tracks": f"""WITH {P.REGIONS}, b AS (SELECT region_id, chrom, unnest(generate_series(start, stop - 1)) AS pos FROM iv),
      v AS (SELECT region_id, pos, CASE WHEN pos % 97 < 40 THEN event_id % 10 END AS value FROM b LEFT JOIN events ON event_id = pos // 97 AND concat('chr', user_id % 5 + 1) = chrom)
      SELECT region_id, count(*)::INT AS n, md5(string_agg(coalesce(value, 0)::VARCHAR, ',' ORDER BY pos)) AS track_md5 FROM v GROUP BY region_id""",
    "a7_fasta_regions": f"""WITH {P.SEQUENCES}, r AS (SELECT seq_id::VARCHAR AS chrom, seq, unnest(generate_series(0, length(seq) - 20, 50)) AS start FROM seqs WHERE length(seq) >= 20),
      s AS (SELECT chrom, start, CASE WHEN start // 50 % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, start + 1, 20) AS own FROM r)
      SELECT chrom, start, strand, CASE WHEN strand = '-' THEN translate(reverse(own), 'ACGT', 'TGCA') ELSE own END AS seq FROM s""",
    "a23_bigwig_signal": f"WITH {P.REGIONS}, {BASES} SELECT chrom, count(*) AS n, sum(v)::BIGINT AS total, sum(v * pos)::DOUBLE AS moment FROM own GROUP BY chrom",
    "a23_bigwig_smooth": f"""WITH {P.REGIONS}, {BASES}, reach AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
      heads AS (SELECT region_id, sum(CASE WHEN reach IS NULL OR reach <= start THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, region_id) AS block FROM reach),
      s AS (SELECT chrom, pos, sum(v) OVER (PARTITION BY chrom, block ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM own JOIN heads USING (region_id))
      SELECT chrom, count(*) AS n, sum(v)::BIGINT AS total, sum(v * pos)::DOUBLE AS moment FROM s GROUP BY chrom""",
    "a15_prediction_files": f"WITH {P.PREDICTIONS} SELECT concept, source AS control, count(*) AS n, sum((pred = truth)::INT)::BIGINT AS n_right FROM pr GROUP BY 1, 2",
    "c10_epochs": "SELECT doc_id, epoch::INT AS epoch, md5(concat_ws(':', '11', epoch::VARCHAR, doc_id::VARCHAR)) AS turn FROM documents, generate_series(0, 2) e(epoch)",
}
ORACLE_SQL |= {name: ORACLE_SQL["a9_interval_tracks"] for name in ("a9_bigwig_scan", "a9_bigwig_regions")}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
