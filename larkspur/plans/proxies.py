"""The test tables seen as intervals, sequences, motifs, signal and predictions; SQL twins beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.sequences import Letters
from larkspur.sources.storage import stored, table


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(
        key.alias("region_id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"),
        (key * 131).alias("start"), (key * 131 + 100 + (key * 37) % 900).alias("stop"),
        F.when(key % 3 == 0, "-").otherwise("+").alias("strand"), F.col("o_orderpriority").alias("concept"))


REGIONS = """iv AS (SELECT o_orderkey::BIGINT AS region_id, concat('chr', o_custkey % 5 + 1) AS chrom, o_orderkey::BIGINT * 131 AS start,
  o_orderkey::BIGINT * 131 + 100 + (o_orderkey::BIGINT * 37) % 900 AS stop, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand, o_orderpriority AS concept FROM orders)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), "lang", F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("seq"))


def stored_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for runs that read them many times: texts are read once, and sequences dealt out evenly, however few files there were."""
    return stored(sequences(spark, sf_dir).repartition(8 * spark.sparkContext.defaultParallelism, "seq_id"), "sequences")


SEQUENCES = "seqs AS (SELECT doc_id AS seq_id, lang, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM documents)"


def genome(rows: DataFrame, size: int) -> DataFrame:
    """Sequences ``chrom, seq`` as chromosomes in chunks of ``size``."""
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))).alias("i", "seq")
    return rows.select("chrom", pieces).select("chrom", (F.col("i").cast("long") * size).alias("chunk_start"), "seq")


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each whole text as a consensus."""
    letters = F.upper(F.regexp_replace("text", "[^acgtACGT]", ""))
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("M/"), F.col("item_id").cast("string")).alias("motif"), letters.alias("consensus"))


MOTIFS = "motifs AS (SELECT concat('M/', item_id) AS motif, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS consensus FROM benchmark)"


def pwm(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Letter frequencies of each language's whole sequences (or those of ``rows``), cut into stretches of 12, at the 12 places of a stretch.

    Letters are counted batch by batch; a partition gives a few rows for each of its languages.
    """
    code = np.zeros(256, np.int64)
    code[list(b"ACGT")] = range(4)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, langs = Letters.of(batch.column("seq")), batch.column("motif").dictionary_encode(null_encoding="encode")
            row = np.repeat(np.arange(batch.num_rows), letters.sizes)
            place = (np.arange(len(letters.flat)) - letters.starts[row]) % 12
            of = langs.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
            counts = np.bincount((of * 12 + place) * 4 + code[letters.flat], minlength=len(langs.dictionary) * 48).reshape(-1, 4)
            there = np.flatnonzero(counts.sum(axis=1))
            columns = [langs.dictionary.take(pa.array(there // 12)), pa.array((there % 12 + 1).astype(np.int32)), *(pa.array(c) for c in counts[there].T)]
            yield pa.RecordBatch.from_arrays(columns, names=["motif", "pos", "a", "c", "g", "t"])

    parts = (sequences(spark, sf_dir) if rows is None else rows).select(F.col("lang").alias("motif"), "seq").mapInArrow(counted, "motif string, pos int, a long, c long, g long, t long")
    every = F.sum(F.col("a") + F.col("c") + F.col("g") + F.col("t"))
    return parts.groupBy("motif", "pos").agg(*[(F.sum(b) / every).alias(b) for b in "acgt"])


PWM = f"""{SEQUENCES}, own AS (SELECT lang AS motif, pos::INT AS pos, regexp_replace(substr(seq, pos), '(.).{{0,11}}', '\\1', 'g') AS own FROM seqs, generate_series(1, 12) s(pos)),
  pwm AS (SELECT motif, pos, """ + ", ".join(f"sum(length(own) - length(replace(own, '{b}', '')))::DOUBLE / sum(length(own))::DOUBLE AS {b.lower()}" for b in "ACGT") + """
  FROM own WHERE own <> '' GROUP BY motif, pos)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points ``chrom, pos, value``, with the event type as chromosome."""
    minute = F.floor(F.unix_timestamp("ts") / 60)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), minute.alias("pos"), F.col("value").cast("double").alias("value"))


SIGNAL = "sig AS (SELECT event_type AS chrom, floor(epoch(ts) / 60)::BIGINT AS pos, value::DOUBLE AS value FROM events)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return both.select("doc_id", F.col("lang").alias("concept"), "source", (1 - F.col("toxic")).cast("int").alias("pred"), F.col("quality").cast("int").alias("truth"))


PREDICTIONS = "pr AS (SELECT l.doc_id, lang AS concept, source, (1 - toxic)::INT AS pred, quality::INT AS truth FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
