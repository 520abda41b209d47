"""Motifs as consensus strings and as position weight matrices in long form
``motif, pos (from 1), a, c, g, t``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.hashing import shuffle_key, uniform
from larkspur.functions.sequence import reverse_complement
from larkspur.operators.relational import numbered

BASES = ("a", "c", "g", "t")
#: Draws after which a permutation that moves too few letters is an error.
ATTEMPTS = 100
#: Draws that are made at once.
DRAWS = 1_024
#: Motifs whose matrices may be gathered on the driver.
MOTIFS = 10_000


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def information(pwm: DataFrame) -> DataFrame:
    """With ``ic``, 2 less the entropy of a place in bits."""
    return pwm.withColumn("ic", 2.0 + sum(entropy_term(F.col(b)) for b in BASES))


def heights(pwm: DataFrame) -> DataFrame:
    """Letter heights of a logo: probability times information."""
    return information(pwm).select("motif", "pos", *[(F.col(b) * F.col("ic")).alias(b) for b in BASES])


def covariates(pwm: DataFrame) -> DataFrame:
    """``motif, len, ic, ic_gc``: length, information and its part in G and C, per motif."""
    return information(pwm).groupBy("motif").agg(F.count(F.lit(1)).alias("len"), F.sum("ic").alias("ic"), F.sum((F.col("g") + F.col("c")) * F.col("ic")).alias("ic_gc"))


def pwm_reverse_complement(pwm: DataFrame) -> DataFrame:
    last = F.max("pos").over(W.partitionBy("motif"))
    return pwm.select("motif", (last + 1 - F.col("pos")).alias("pos"), F.col("t").alias("a"), F.col("g").alias("c"), F.col("c").alias("g"), F.col("a").alias("t"))


def with_reverse_complements(consensus: DataFrame) -> DataFrame:
    """``motif, consensus, is_rc``: every consensus and its reverse complement; the input isn't changed."""
    flipped = consensus.select("motif", reverse_complement(F.col("consensus")).alias("consensus"), F.lit(True).alias("is_rc"))
    return consensus.select("motif", "consensus", F.lit(False).alias("is_rc")).unionByName(flipped)


def consensus_table(rows: DataFrame) -> DataFrame:
    """``motif, variants``: all upper-cased consensus strings of a name, sorted and joined by commas."""
    return rows.groupBy("motif").agg(F.array_join(F.array_sort(F.collect_list(F.upper("consensus"))), ",").alias("variants"))


def merged_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Names made different: the second and later get the suffix ``_1``, ``_2``, ... in ``order``."""
    nth = F.col("ordinal")
    suffix = F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise("")
    return numbered(rows, *order, by=[name]).withColumn("unique_name", F.concat(F.col(name), suffix)).drop("ordinal")


def sampled(pwm: DataFrame, draws: int, seed: str) -> DataFrame:
    """``motif, draw, seq``: a letter per place by its cumulative probabilities; what rounding leaves over is T."""
    each = pwm.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform(seed, F.col("motif"), F.col("draw"), F.col("pos"))
    letter = F.when(u < F.col("a"), "A").when(u < F.col("a") + F.col("c"), "C").when(u < F.col("a") + F.col("c") + F.col("g"), "G").otherwise("T")
    parts = F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"))))
    return each.groupBy("motif", "draw").agg(F.array_join(F.transform(parts, lambda x: x["letter"]), "").alias("seq"))


def drawn(spark: SparkSession, matrix: np.ndarray, n: int, seed: int) -> DataFrame:
    """``draw, seq``: ``n`` draws from one matrix, ``DRAWS`` at a time as arrays; what is left over by rounding is T.

    Every lot has a generator seeded by its number, so results don't depend on partitions.
    """
    cumulative, width = np.cumsum(np.asarray(matrix, float), axis=1), len(matrix)
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in batch.column("id").to_pylist():
                size = min(DRAWS, n - lot * DRAWS)
                u = np.random.default_rng([seed, lot]).random((size, width))
                index = sum((u >= cumulative[:, k]).astype(np.uint8) for k in range(3))
                ends = np.arange(size + 1, dtype=np.int32) * width
                seqs = pa.StringArray.from_buffers(size, pa.py_buffer(ends), pa.py_buffer(letters[index].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size) + lot * DRAWS), seqs], names=["draw", "seq"])

    return spark.range(-(-n // DRAWS)).mapInArrow(run, "draw long, seq string")


def permuted(consensus: DataFrame, least_moved: float, seed: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``motif, consensus, permuted, moved``: the first permutation that moves at least that share of letters.

    Attempts are made one after another, in the motif's own row; an error if all ``attempts`` fail.
    """
    letters = F.split("consensus", "")

    def attempt(k: Column) -> Column:
        order = F.array_sort(F.transform(letters, lambda c, i: F.struct(shuffle_key(seed, F.col("motif"), i, k).alias("key"), i.alias("pos"), c.alias("letter"))))
        moved = F.aggregate(F.transform(order, lambda x, i: (x["pos"] != i).cast("int")), F.lit(0), lambda a, b: a + b) / F.size(letters)
        return F.struct(F.array_join(F.transform(order, lambda x: x["letter"]), "").alias("permuted"), moved.alias("moved"))

    none = F.struct(F.lit(None).cast("string").alias("permuted"), F.lit(-1.0).alias("moved"))
    best = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), none, lambda x, k: F.when(x["moved"] >= least_moved, x).otherwise(attempt(k)))
    failed = F.raise_error(F.concat(F.lit(f"no permutation in {attempts} moves enough letters of "), F.col("motif")))
    return consensus.withColumn("best", best).select("motif", "consensus", F.when(F.col("best.moved") >= least_moved, F.col("best.permuted")).otherwise(failed).alias("permuted"), F.col("best.moved").alias("moved"))


def merged_consensus(tables: Sequence[DataFrame]) -> DataFrame:
    """``motif, consensus`` of several tables one after another, upper-cased; a name may come from several."""
    rows = reduce(lambda a, b: a.unionByName(b), [t.select("motif", "consensus") for t in tables])
    return rows.withColumn("consensus", F.upper("consensus"))


def matrices(pwm: DataFrame) -> dict[str, np.ndarray]:
    """Matrices by motif, places by letters, on the driver; an error beyond ``MOTIFS`` of them."""
    rows = pwm.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("pos", *BASES))).alias("rows")).limit(MOTIFS + 1).collect()
    if len(rows) > MOTIFS:
        raise ValueError(f"more than {MOTIFS} motifs")
    return {r.motif: np.array([[x[b] for b in BASES] for x in r.rows], float) for r in rows}


def consensus_matrix(consensus: str) -> np.ndarray:
    """The matrix that always gives this string; an error for other letters than A, C, G, T."""
    return np.eye(4)[["ACGT".index(c) for c in consensus.upper()]]


def permuted_matrix(matrix: np.ndarray, rng: np.random.Generator, least_moved: float = 0.3) -> np.ndarray:
    """Its places in another order, in which at least that share of them move; an error after ``ATTEMPTS``."""
    for _ in range(ATTEMPTS):
        order = rng.permutation(len(matrix))
        if (order != np.arange(len(matrix))).mean() >= least_moved:
            return np.asarray(matrix)[order]
    raise ValueError(f"no permutation in {ATTEMPTS} moves enough places")


def pssm_hits(sequences: DataFrame, pwm: DataFrame, threshold: float = 2.0, floor: float = 1e-3) -> DataFrame:
    """``seq_id, motif, hits``: windows on either strand whose log-odds against even letters reach ``threshold``.

    The matrices, a few numbers for each of at most ``MOTIFS`` motifs, are gathered and sent to the tasks; sequences stay where they
    are, and their windows are scored together, batch by batch. Windows with other letters don't count.
    """
    odds = {motif: np.log2(np.maximum(m, floor) / 0.25) for motif, m in sorted(matrices(pwm).items())}
    code = np.full(256, 4, np.int8)
    code[list(b"ACGT")] = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("seq")]
            flat, sizes = code[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)
            ends = np.repeat(np.cumsum(sizes), sizes)
            row = np.repeat(np.arange(len(texts)), sizes)
            for motif, m in odds.items():
                width, n = len(m), max(0, len(flat) - len(m) + 1)
                inside = np.arange(n) + width <= ends[:n]
                hits = np.zeros(len(texts), np.int64)
                for strand in (m, m[::-1, ::-1]):
                    padded = np.column_stack([strand, np.full(width, -np.inf)])
                    score = np.zeros(n)
                    for i in range(width):
                        score += padded[i][flat[i : i + n]]
                    hits += np.bincount(row[:n][inside & (score >= threshold)], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array([motif] * len(texts), pa.string()), pa.array(hits)], names=["seq_id", "motif", "hits"])

    return sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").mapInArrow(run, "seq_id long, motif string, hits long")


def meme_text(pwm: DataFrame) -> DataFrame:
    """``motif, text``: a motif's lines in the minimal MEME format, six decimals."""
    lines = F.array_sort(F.collect_list(F.struct("pos", F.format_string("%.6f %.6f %.6f %.6f", *BASES).alias("line"))))
    body = pwm.groupBy("motif").agg(F.transform(lines, lambda x: x["line"]).alias("lines"))
    head = F.format_string("MOTIF %s\nletter-probability matrix: alength= 4 w= %d nsites= 20 E= 0\n", "motif", F.size("lines"))
    return body.select("motif", F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def parsed_meme(chunks: DataFrame) -> DataFrame:
    """``motif, pos, a, c, g, t`` from ``value``s that each begin with ``MOTIF name`` or just the name (as text
    split at ``MOTIF ``); other chunks, such as the file's head, give nothing."""
    body = F.regexp_replace("value", "^MOTIF ", "")
    named = chunks.filter(F.contains("value", F.lit("letter-probability matrix"))).select(F.regexp_extract(body, r"^(\S+)", 1).alias("motif"), F.regexp_replace(body, r"(?s)^.*?letter-probability matrix[^\n]*\n", "").alias("rows"))
    lines = named.select("motif", F.posexplode(F.filter(F.split("rows", "\n"), lambda x: x.rlike(r"^\s*[0-9]"))).alias("pos", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    return lines.select("motif", (F.col("pos") + 1).alias("pos"), *[cells[i].cast("double").alias(b) for i, b in enumerate(BASES)])
