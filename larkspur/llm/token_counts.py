"""Exact token counts from a histogram of encoded lengths.

Every document is encoded once, to its length only; lengths are added up per partition before
the shuffle, so a length that a third of all documents share costs no more than another, and the histogram is stored. Suffix sums over
the histogram then answer, for every limit: how many documents are at least that long, the
tokens in them, and the corpus's tokens after truncation to the limit; and any quantile.

Suffix sums run over blocks of ``BLOCK`` lengths, then within each block, so no task sees the whole
histogram unless lengths lie in one block. Edge cases: null texts are empty and have length 0;
repeated rows, null ids and other columns change nothing; an empty table has an empty histogram, 0 totals
and null quantiles.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, text_slices
from larkspur.sources.storage import stored, table

VOCABULARY = "byte_bpe_50k.tiktoken"
LIMITS = (128, 512, 1024, 2048, 4096, 8192)
QUANTILES = (0.5, 0.9, 0.99)
BLOCK = 256


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """One per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for part in text_slices(batches):
            lengths, n = np.unique(np.array([len(encode(x.as_py() or "")) for x in part.column("text")], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(n)], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``, one row per length that occurs; stored, since suffix sums read it twice."""
    run = _counted(path or public_tokenizers.path(VOCABULARY))
    counted = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return stored(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with ``docs_from`` and ``tokens_from`` (documents at least that long, and their
    tokens) and ``tokens_truncated`` (all tokens if texts were cut to that length)."""
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)  # one row per block of lengths
    every = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"), F.sum("tokens").over(every).alias("tokens_all"))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    docs_from, tokens_from = F.sum("n_docs").over(within) + F.col("docs_later"), F.sum("tokens").over(within) + F.col("tokens_later")
    return rows.join(sums, "block").select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (F.col("tokens_all") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_truncated"))


def answers(histogram: DataFrame, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``question, at, value``: ``total`` tokens; ``truncated`` tokens for each limit; for each
    quantile q the smallest length that a share of at least q of the documents doesn't exceed."""
    return _answered(stored(suffix_sums(histogram), "suffix-sums"), limits, quantiles)


def _answered(sums: DataFrame, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    whole = sums.agg(F.max("tokens_from").alias("tokens"), F.max("docs_from").alias("docs")).first()
    tokens, docs = whole.tokens or 0, whole.docs or 0
    from_ = lambda limit, what: F.max(F.when(F.col("n_tokens") >= limit, F.col(what)))
    upto = F.lit(docs) - F.col("docs_from") + F.col("n_docs")
    asked = [from_(x, what) for x in limits for what in ("tokens_from", "docs_from")]
    asked += [F.min(F.when(upto >= math.ceil(q * docs), F.col("n_tokens"))) for q in quantiles]
    found = list(sums.agg(*(c.alias(f"a{i}") for i, c in enumerate(asked))).first()) if asked else []
    rows = [("total", None, tokens)]
    rows += [("truncated", float(x), tokens - (found[2 * i] or 0) + (found[2 * i + 1] or 0) * int(x)) for i, x in enumerate(limits)]
    rows += [("quantile", float(q), found[2 * len(limits) + i]) for i, q in enumerate(quantiles)]
    return sums.sparkSession.createDataFrame(rows, "question string, at double, value long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per length (``question`` is ``length``, ``value`` the tokens truncated to it), then the rows of ``answers``."""
    sums = stored(suffix_sums(length_histogram(table(spark, sf_dir, "documents"))), "suffix-sums")
    lengths = sums.select(F.lit("length").alias("question"), F.col("n_tokens").cast("double").alias("at"), F.col("tokens_truncated").alias("value"), "*")
    return lengths.unionByName(_answered(sums), allowMissingColumns=True)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
