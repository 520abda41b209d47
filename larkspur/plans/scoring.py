"""Concept scores: statistics, directions, classification, attribution signs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import vectors as V
from larkspur.sources.storage import table

COUNTS = ("n", "n_pos", "n_neg", "tp", "fp", "fn")
#: Labels times dimensions whose moments are gathered.
CELLS = 5_000_000
LONG_SQL = "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS v FROM embeddings"


def class_moments(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Labels and, by label and dimension, numbers, means and population variances of ``label, v``, of the length that most vectors have.

    One pass; each partition adds up its vectors as matrices, and only (labels x dimensions) numbers of it are shuffled or reach the driver. More
    than ``CELLS`` of them are an error.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            sizes, label = batch.column("v").value_lengths().to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                x = batch.column("v").filter(pa.array(sizes == size)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                of = label[sizes == size]
                for k in np.unique(of).tolist():
                    own = x[of == k]
                    mean = own.mean(axis=0)
                    n, m, q = found.get((size, k), (0, 0.0, 0.0))
                    every = n + len(own)
                    # Sums of squares about the mean, put together.
                    q = q + ((own - mean) ** 2).sum(axis=0) + (mean - m) ** 2 * (n * len(own) / every)
                    found[size, k] = (every, m + (mean - m) * (len(own) / every), q)
        for (size, k), (n, m, q) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([size] * size, pa.int32()), pa.array([n] * size, pa.int64()), pa.array(m), pa.array(q)], names=["label", "d", "size", "n", "m", "q"])

    parts = rows.select(F.col("label").cast("int").alias("label"), "v").mapInArrow(summed, "label int, d int, size int, n long, m double, q double")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    spread = F.sum(F.col("q") + F.col("n") * F.col("m") * F.col("m")) / n - mean * mean
    cells = parts.groupBy("label", "size", "d").agg(n.alias("n"), mean.alias("m"), F.greatest(spread, F.lit(0.0)).alias("q")).limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} labels times dimensions")
    by_size: dict[int, int] = {}
    for c in cells:
        by_size[c.size] = by_size.get(c.size, 0) + c.n * (c.d == 0)
    most = min(by_size, key=lambda k: (-by_size[k], k), default=0)
    cells = sorted((c for c in cells if c.size == most), key=lambda c: (c.label, c.d))
    labels = sorted({c.label for c in cells})
    shaped = lambda name: np.array([c[name] for c in cells], float).reshape(len(labels), -1)
    return (labels, shaped("n"), shaped("m"), shaped("q")) if labels else ([], *(np.zeros((0, 0)),) * 3)


def flagship_concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concept (label) against the control (label 0): sign counts of attribution . direction,
    their log ratio, and the F-score of the midpoint classifier.

    Means and deviations follow from the moments of the classes. Samples stay where they were read: Arrow batches are
    scored as matrices against all directions, and only counts per concept and partition are shuffled.
    """
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity'))").select("label", F.col("embedding").cast("array<double>").alias("v"))
    labels, n, m, q = class_moments(rows)
    if 0 not in labels:  # no control, no scores
        return table(spark, sf_dir, "embeddings").sparkSession.createDataFrame([], "concept int, n long, n_pos long, n_neg long, log_ratio double, fscore double")
    rows = rows.filter(F.size("v") == m.shape[1])
    mean = (n * m).sum(axis=0) / n.sum(axis=0)
    std = np.sqrt((n * (q + (m - mean) ** 2)).sum(axis=0) / (n.sum(axis=0) - 1))
    std[std == 0] = -1.0
    centres, at = (m - mean) / std, labels.index(0)
    concepts = [x for x in labels if x != 0]
    own = np.array([i for i, x in enumerate(labels) if x != 0], int)
    w = centres[own] - centres[at]
    cut = (w * (centres[own] + centres[at]) / 2).sum(axis=1)
    head = w * ((np.arange(w.shape[1]) % 7) - 3) / 3.0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(concepts), len(COUNTS)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean) / std
            label = batch.column("label").to_numpy(zero_copy_only=False)[:, None]
            score, side = np.abs(z - centres[at]) @ head.T, z @ w.T > cut
            target, mine = label != 0, label == np.array(concepts)
            found = (target & np.ones_like(side), target & (score > 0), target & (score < 0), mine & side, ~target & side, mine & ~side)
            total += np.stack([x.sum(axis=0) for x in found], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(concepts, pa.int32()), *(pa.array(c) for c in total.T)], names=["concept", *COUNTS])

    parts = rows.mapInArrow(counted, "concept int, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = parts.groupBy("concept").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return counts.select(
        "concept", "n", "n_pos", "n_neg",
        F.round(V.log_ratio(F.col("n_pos"), F.col("n_neg")), 6).alias("log_ratio"),
        F.round(V.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("fscore"))


FLAGSHIP_SQL = f"""
WITH l AS ({LONG_SQL}),
s AS (SELECT d, avg(v) AS mean, CASE WHEN stddev_samp(v) = 0 THEN -1.0 ELSE stddev_samp(v) END AS std FROM l GROUP BY d),
z AS (SELECT vec_id, label, l.d, (v - mean) / std AS z FROM l JOIN s ON l.d = s.d),
m AS (SELECT label, d, avg(z) AS m FROM z GROUP BY label, d),
c AS (SELECT a.label AS concept, a.d, a.m - b.m AS w, (a.m + b.m) / 2 AS mid, b.m AS m0 FROM m a JOIN m b ON a.d = b.d AND b.label = 0 WHERE a.label <> 0),
p AS (SELECT vec_id, label, concept, sum(abs(z - m0) * ((z.d % 7) - 3) / 3.0::DOUBLE * w) AS score, sum((z - mid) * w) AS side
      FROM z JOIN c ON z.d = c.d GROUP BY vec_id, label, concept),
n AS (SELECT concept, count(*) FILTER (label <> 0) AS n, count(*) FILTER (label <> 0 AND score > 0) AS n_pos, count(*) FILTER (label <> 0 AND score < 0) AS n_neg,
      count(*) FILTER (label = concept AND side > 0) AS tp, count(*) FILTER (label = 0 AND side > 0) AS fp, count(*) FILTER (label = concept AND side <= 0) AS fn
      FROM p GROUP BY concept)
SELECT concept, n, n_pos, n_neg, round(ln((n_pos + 1.0::DOUBLE) / (n_neg + 1.0::DOUBLE)), 6) AS log_ratio,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0::DOUBLE), 6) AS fscore FROM n
"""

QUERIES = {"flagship_concept_scores": flagship_concept_scores}
ORACLE_SQL = {"flagship_concept_scores": FLAGSHIP_SQL}
