"""Approximate nearest neighbours by largest inner product, with a permutation index.

Up to ``PIVOTS`` vectors, from a bounded sample, are pivots. A vector is represented by its pivots in order
of nearness, and posted in every pivot's inverted file with the pivot's place in that order. A query
orders the pivots likewise; summing, over the inverted files, how far apart the two places are gives the
footrule distance of the two orders. The ``DEPTH`` share of lowest footrule, of a block of any size, is reranked by the exact inner
product (or as many as are asked for, if that is more).
Norms may differ: vectors are lifted to equal length by one more component, on which queries have 0, so
that order of nearness and of inner product agree.

All vectors are indexed. They are dealt by id into blocks of about ``BLOCK`` and queries into chunks of
about ``CHUNK``; each pair of a block and a chunk is one task's work, and a query's best of every block are
then merged. Equal vectors of a block are one point with the smallest ids it can need, so
copies neither crowd out others nor break ties wrongly.

Edge cases: null vectors and those that are zero, hold null or non-finite components or have
another length than most take no part, nor do null ids; rows that repeat an id count as one, with its best
score, and never as their own neighbour; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.sources.storage import stored, table

PIVOTS = 128
#: Rows that pivots are chosen from, by a hash of the id.
PIVOT_SAMPLE = 1_024
BLOCK, CHUNK = 8_192, 8_192
#: Share of a block that is reranked.
DEPTH = 0.25
NEAREST = 20


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part, in double precision; stored, as several jobs read them."""
    doubles = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = stored(doubles.filter(finite & F.exists("vector", lambda x: x != 0)), "vectors")
    most = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.filter(F.size("vector") == (most.n if most else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def lifted(vectors: np.ndarray, radius: float) -> np.ndarray:
    """With one more component, so that all have length ``radius``."""
    rest = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of every pivot in each vector's order, nearest first: pivots by vectors."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)  # a footrule is under half the square of the pivots, so it fits too
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return np.ascontiguousarray(out.T)


class Block:
    """The inverted files of one block: ``files[p]`` has pivot p's place in every distinct vector's order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, radius: float, nearest: int, depth: float = DEPTH):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        again = ~new & np.r_[False, ids[1:] == ids[:-1]]
        ids, vectors, new = ids[~again], vectors[~again], new[~again]
        self.starts = np.flatnonzero(new)
        copies = np.diff(np.r_[self.starts, len(ids)])
        self.copies = np.minimum(copies, nearest + 1)  # one may be the query itself
        self.ids, self.vectors = ids, vectors[self.starts]
        self.files = places(lifted(self.vectors, radius), pivots)
        self.apart = np.empty_like(self.files)  # overwritten by each query
        self.depth = min(len(self.vectors), max(nearest + 1, int(np.ceil(depth * len(self.vectors)))))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        np.subtract(self.files, order[:, None], out=self.apart)
        return np.abs(self.apart, out=self.apart).sum(axis=0, dtype=np.int16)

    def best(self, query: int, vector: np.ndarray, order: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's nearest, reranked from the lowest footrules."""
        near = np.argpartition(self.footrule(order), self.depth - 1)[: self.depth] if self.depth < len(self.vectors) else np.arange(len(self.vectors))
        some = self.vectors[near]
        if len(near) > nearest + 1:  # by a quick product, those that may be among the nearest, ties and rounding included
            quick = some @ vector
            kept = quick >= np.partition(quick, len(quick) - nearest - 1)[len(quick) - nearest - 1] - 1e-9 * (1 + np.abs(quick).max())
            near, some = near[kept], some[kept]
        score = (some * vector).sum(axis=1)
        n = self.copies[near]
        at = np.repeat(self.starts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids, scores = self.ids[at], np.repeat(score, n)
        ids, scores = ids[ids != query], scores[ids != query]
        first = np.lexsort((ids, -scores))[:nearest]
        return ids[first], scores[first]


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, depth: float = DEPTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: of ``vectors(id, vector)``, those nearest to each of ``queries``.

    Both have the rows of ``usable``; ranks begin at 1, ties go to the smaller id.
    """
    n, m = vectors.count(), queries.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-m // CHUNK))
    radius = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    radius = float(np.sqrt(radius or 0.0))
    drawn = vectors.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(PIVOT_SAMPLE).collect()
    distinct = list(dict.fromkeys(tuple(r.vector) for r in drawn))[:PIVOTS]
    pivots = lifted(np.array(distinct), radius) if distinct else np.zeros((0, 1))

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = Block(left.column("id").to_numpy(), matrix(left.column("vector")), pivots, radius, nearest, depth)
            asked, of = right.column("id").to_numpy(), matrix(right.column("vector"))
            orders = places(np.column_stack([of, np.zeros(len(of))]), pivots)
            for i, query in enumerate(asked.tolist()):
                ids, scores = block.best(query, of[i], orders[:, i], nearest)
                found.append((np.full(len(ids), query), ids, scores))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": parts[0].astype(np.int64), "vec_id": parts[1].astype(np.int64), "score": parts[2]})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    right = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(cell, "query_id long, vec_id long, score double")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = found.repartition(parts, "query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.filter("id % 20 = 0"))


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE_SQL: dict[str, str] = {}
