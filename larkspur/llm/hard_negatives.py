"""Hard negatives by blocked dense products of anchors and candidates.

Components are scaled to whole numbers, so an inner product in double precision is exact below 2**53. Anchors are
taken in waves of about ``WAVE_BYTES``, each broadcast; every task lets its part of all candidates stream by, multiplies
blocks of ``ROWS`` candidates with blocks of ``TILE`` anchors and keeps, for each anchor, only the best so far. These lists
are small and mergeable: a first pass gives each anchor's nearest rows of its own label (the positives), a
second one, for each anchor and positive, the best rows of other labels whose score lies in the window
that the positive's score sets. Candidates are stored once and read by both passes; they never move.

Edge cases: rows take no part if id, label or vector is null, or a component is null, not finite or too large to be scaled;
rows that repeat an id are rows like others: an anchor leaves out itself, not those of its id, and each anchor row has results of its own
(equal ones for equal rows); vectors of unequal length count as filled up with zeros; products of 2**53 and more are computed
again in whole numbers, and beyond the range of a long they are its ends; other columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded
from larkspur.sources.storage import discard, shared_dir, stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of the positive's.
FROM, TO = 50, 95
#: Bytes of the anchors that are broadcast together.
WAVE_BYTES = 16 << 20
TILE, ROWS, FIRST_ROWS = 1_024, 2_048, 256
_EXACT, _END = float(1 << 53), (1 << 63) - 1
_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``row, id, label, vector`` of the rows that take part; stored, as both passes of every wave read them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    sound = chosen.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite)
    return stored(sound.repartition(parts).withColumn("row", F.monotonically_increasing_id()), "candidates")


def scaled(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Whole components as doubles, a row each; filled up with zeros, or cut, to ``width`` (that of the longest if none)."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    values = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False)) + 0.0  # no negative zero
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, kept = np.zeros((len(sizes), width)), place < width
    out[np.repeat(np.arange(len(sizes)), sizes)[kept], place[kept]] = values[kept]
    return out


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: anchors by candidates."""
    out = anchors @ candidates.T
    lengths = [np.sqrt((x**2).sum(axis=1)) for x in (anchors, candidates)]
    if lengths[0].max(initial=0) * lengths[1].max(initial=0) < _EXACT:  # no sum on the way is larger than this
        return out.astype(np.int64)
    large = np.outer(*lengths) >= _EXACT
    exact = np.where(large, 0, out).astype(np.int64)
    for i, j in zip(*np.nonzero(large)):
        exact[i, j] = max(-_END, min(_END, sum(int(a) * int(b) for a, b in zip(anchors[i].tolist(), candidates[j].tolist()))))
    return exact


def few_copies(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that can be among the first ``most`` of any list: of equal ones, those of the smallest ids."""
    raw = np.ascontiguousarray(np.column_stack([labels.view(np.float64), vectors]))
    group = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < most]


class Best:
    """The first ``most`` of each line, by descending score, then ascending id."""

    def __init__(self, lines: int, most: int):
        self.score, self.id = np.full((lines, most), -_END - 1), np.full((lines, most), _END)
        self.count = np.zeros(lines, np.int64)

    def floor(self, lines: slice) -> np.ndarray:
        """Scores below this can't get in."""
        return self.score[lines, -1]

    def add(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last = self.score[line, -1]
        entered = (score > last) | (score == last) & (ids < self.id[line, -1]) | (self.count[line] < self.score.shape[1])
        line, score, ids = line[entered], score[entered], ids[entered]
        if not len(line):
            return
        touched, most = np.unique(line), self.score.shape[1]
        held = np.arange(most)[None, :] < self.count[touched][:, None]
        line = np.r_[line, np.repeat(touched, most)[held.ravel()]]
        score, ids = np.r_[score, self.score[touched][held]], np.r_[ids, self.id[touched][held]]
        order = np.lexsort((ids, -score, line))
        line, score, ids = line[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        place = np.arange(len(line)) - np.repeat(starts, np.diff(np.r_[starts, len(line)]))
        kept = place < most
        self.score[line[kept], place[kept]], self.id[line[kept], place[kept]] = score[kept], ids[kept]
        self.count[touched] = np.minimum(np.diff(np.r_[starts, len(line)]), most)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.nonzero(np.arange(self.score.shape[1])[None, :] < self.count[:, None])
        return at[0], self.score[at], self.id[at]


class Blocks(NamedTuple):
    """Anchors and candidates of a block; candidates are fewer at first, until lists have filled up."""

    tile: int = TILE
    rows: int = ROWS
    first_rows: int = FIRST_ROWS


def _streamed(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, most: int, blocks: Blocks, meet: Callable) -> None:
    """Call ``meet(first anchor, products, ids, labels)`` for every block of candidates and of anchors."""
    size = blocks.first_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
        vectors = scaled(batch.column("vector"), anchors.shape[1])
        kept = few_copies(ids, labels, vectors, most)
        start = 0
        while start < len(kept):
            now = kept[start : start + size]
            for a in range(0, len(anchors), blocks.tile):
                meet(a, products(anchors[a : a + blocks.tile], vectors[now]), ids[now], labels[now])
            start, size = start + size, blocks.rows


def _nearest(candidates: DataFrame, wave, most: int, blocks: Blocks) -> DataFrame:
    """``line, score, id``: the first ``most`` rows of the label of each anchor of the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, own = wave.value["vectors"], wave.value["labels"]
        best = Best(len(anchors), most)

        def meet(a: int, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            lines = slice(a, a + len(score))
            i, j = np.nonzero((own[lines, None] == labels) & (score >= best.floor(lines)[:, None]))
            best.add(i + a, score[i, j], ids[j])

        _streamed(batches, anchors, most, blocks, meet)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["line", "score", "id"])

    return candidates.mapInArrow(run, "line long, score long, id long")


def _in_window(candidates: DataFrame, wave, most: int, blocks: Blocks) -> DataFrame:
    """``line, score, id``: the first ``most`` rows of other labels in each window; lines are windows, anchor by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, own, low, high = (wave.value[k] for k in ("vectors", "labels", "low", "high"))
        windows = low.shape[1]
        best = Best(low.size, most)

        def meet(a: int, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            lines = slice(a, a + len(score))
            other = own[lines, None] != labels
            for w in range(windows):
                least = np.maximum(low[lines, w], best.score[a * windows + w : (a + len(score)) * windows : windows, -1])
                i, j = np.nonzero(other & (score >= least[:, None]) & (score <= high[lines, w, None]))
                best.add((i + a) * windows + w, score[i, j], ids[j])

        _streamed(batches, anchors, most, blocks, meet)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["line", "score", "id"])

    return candidates.mapInArrow(run, "line long, score long, id long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """Of all tasks' lists, the first ``most`` of each line, with ``rank`` from 1."""
    rank = F.row_number().over(W.partitionBy("line").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _table(rows: pa.Table, lines: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and a mask of those that exist: lines by ranks."""
    line, rank = rows.column("line").to_numpy(), rows.column("rank").to_numpy() - 1
    score, ids, there = np.zeros((lines, most), np.int64), np.zeros((lines, most), np.int64), np.zeros((lines, most), bool)
    score[line, rank], ids[line, rank], there[line, rank] = rows.column("score").to_numpy(), rows.column("id").to_numpy(), True
    return score, ids, there


def _without_self(score: np.ndarray, ids: np.ndarray, there: np.ndarray, own_score: np.ndarray, own_id: np.ndarray) -> tuple[np.ndarray, ...]:
    """One rank fewer: the anchor's own place goes, or the last one."""
    own = there & (ids == own_id[:, None]) & (score == own_score[:, None])
    out = np.where(own.any(axis=1), own.argmax(axis=1), score.shape[1] - 1)
    kept = np.arange(score.shape[1])[None, :] != out[:, None]
    return tuple(x[kept].reshape(len(x), -1) for x in (score, ids, there))


def mine(candidates: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, wave_bytes: int = WAVE_BYTES, blocks: Blocks = Blocks()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows of ``usable`` that ``anchors`` picks."""
    spark = candidates.sparkSession
    picked = candidates.filter(anchors)
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    waves = -(-size.n * 8 * max(1, size.width or 0) // wave_bytes)
    place, made = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", []
    for k in range(waves):
        own = picked.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == k).select("id", "label", "vector").toArrow()
        if not own.num_rows:
            continue
        ids, data = own.column("id").to_numpy(), {"vectors": scaled(own.column("vector")), "labels": own.column("label").to_numpy()}
        wave = spark.sparkContext.broadcast(data)
        near = _first(_nearest(candidates, wave, positives + 1, blocks), positives + 1).toArrow()
        own_score = np.concatenate([np.diag(products(x, x)) for x in np.split(data["vectors"], range(TILE, len(ids), TILE))])
        score, near_ids, there = _without_self(*_table(near, len(ids), positives + 1), own_score, ids)
        low = np.where(there, *_bounds(score)[:1], 1)
        high = np.where(there, *_bounds(score)[1:], 0)
        windows = spark.sparkContext.broadcast(data | {"low": low, "high": high})
        names = spark.sparkContext.broadcast((np.repeat(ids, positives), near_ids.ravel(), score.ravel()))
        _named(_first(_in_window(candidates, windows, negatives, blocks), negatives), names).write.parquet(f"{place}/{k}")
        made.append(f"{place}/{k}")
        for sent in (wave, windows, names):
            sent.unpersist()
    return spark.read.schema(_SCHEMA).parquet(*made) if made else spark.createDataFrame([], _SCHEMA)


def _bounds(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of a window, without products that pass a long."""
    whole, rest = np.divmod(score, 100)
    return FROM * whole - (-FROM * rest) // 100, TO * whole + TO * rest // 100


def _named(found: DataFrame, names) -> DataFrame:
    """Lines of windows with the ids and the score that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positive, score = names.value
        for batch in batches:
            line = batch.column("line").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchor[line]), pa.array(positive[line]), batch.column("rank").cast(pa.int32()), batch.column("id"), pa.array(score[line]), batch.column("score")], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return found.mapInArrow(run, _SCHEMA)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    candidates = usable(bounded(table(spark, sf_dir, "embeddings")), "vec_id", "embedding", label)
    found = mine(candidates, F.col("id") % 50 == 0)
    discard(candidates)
    return found


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {
    "op11_hard_negatives": """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) for x in embedding] AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), pairs AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
      SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    ), ranked AS (
      SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS nth,
        other AS negative_id, positive_score, score AS negative_score
      FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE nth <= 3
    """,
}
