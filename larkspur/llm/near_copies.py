"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of at least ``LIKE``.

Texts of equal sets are one point. Its SimHash over these shingles is linked by the anchors of ``simhash`` to those
within 3 bits. At a similarity of 0.8 two SimHashes differ in 10 of 64 bits on average, which anchors can't cover, so points
are also candidates if they share one of ``BANDS`` hashes, each of the smallest values of the
shingles under ``ROWS`` permutations (at a similarity of 0.8 with a
probability of 0.9998, above it more, at 0.3 of 0.02). All candidates are compared by their whole sets, in groups of any size alike.

First every band's first point, its leader, meets the others, and the SimHash links are compared: near copies of one text are linked by that, with each text
moved once for each leader it has. Then only bands whose other points aren't all linked yet go on: those outside the band's largest group of linked
points meet all of it. Points are dealt into chunks of at most about ``CELL`` points and ``SHINGLES`` shingles; of a pair of chunks a task holds the sets of one, and
the others pass by one at a time.

Edge cases: texts without words are copies of each other; texts of fewer than 5 words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.batches import bounded, returned, text_slices
from larkspur.llm.components import connected_components
from larkspur.llm.fingerprints import _FACTORS, _mixed, sketches
from larkspur.llm.simhash import one_of_each, row_key
from larkspur.sources.storage import discard, stored

LIKE = 0.8
BANDS, ROWS = 28, 6
#: Points, and shingles of them, that a task holds to compare others with.
CELL, SHINGLES = 128, 1 << 18
#: Bytes of a row group of texts; a task that writes them holds one.
TEXT_BLOCK = 8 << 20
#: No bound on the shingles of a text.
ALL = 1 << 62
_random = np.random.default_rng(42)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The hashes of a set of shingles; none if it is empty."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[i : i + 512, None] * _TIMES + _PLUS).min(axis=0))
    return _mixed((low.reshape(BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sim(shingles: np.ndarray) -> int | None:
    """The SimHash of a set of shingles, as a signed long; none if it is empty."""
    if not len(shingles):
        return None
    bits = np.flatnonzero(2 * simhash.bit_counts(shingles) > len(shingles)).astype(np.uint64)
    return int((np.uint64(1) << bits).sum(dtype=np.uint64).view(np.int64))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        made = sketches(part.column("text"), ALL)
        fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in made], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("no_id", "id", "of_text")), pa.array(fps), pa.array([sim(x) for x in made], pa.int64()), pa.array([bands(x) for x in made], pa.list_(pa.int64())), pa.array([len(x) for x in made], pa.int64())], names=["no_id", "id", "of_text", "fp", "sim", "bands", "size"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the first point of each band and its others; rows are sorted by band."""
    band, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "fp"))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        firsts = fps[starts]
        if at[0] == band:
            firsts[0] = first
        u = np.repeat(firsts, np.diff(np.r_[starts, len(at)]))
        band, first = at[-1], u[-1]
        yield pa.RecordBatch.from_arrays([pa.array(u[u != fps]), pa.array(fps[u != fps])], names=["u", "v"])


class Held:
    """The sets of a task's chunk, one after another; none is empty."""

    def __init__(self) -> None:
        self.sets, self.names, self.label, self.flat = [], [], [], None

    def add(self, name: int, own: np.ndarray) -> None:
        self.label.append(len(self.sets))
        self.sets.append(own)
        self.names.append(name)

    def alike(self, other: np.ndarray, like: float = LIKE) -> list[int]:
        """The places of the sets that have a similarity of at least ``like`` with another one."""
        if self.flat is None:
            self.size = np.array([len(x) for x in self.sets])
            self.flat, self.starts, self.sets = np.concatenate(self.sets), np.cumsum(self.size) - self.size, []
        at = np.searchsorted(other, self.flat)
        met = other[np.minimum(at, len(other) - 1)] == self.flat
        common = np.add.reduceat(met, self.starts, dtype=np.int64)
        return np.flatnonzero(common >= like * (self.size + len(other) - common) - 1e-9).tolist()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between points of each cell, of those that are held (side 0, first) with the others; no more than connect what all such links connect."""
    cell, held = None, Held()
    for part in text_slices(batches):
        u, v = [], []
        for group, number, side, fp, own in zip(*(part.column(c).to_pylist() for c in ("group", "cell", "side", "fp")), sketches(part.column("text"), ALL)):
            if (group, number) != cell:
                cell, held = (group, number), Held()
            own = np.sort(own)
            if side == 0:
                held.add(fp, own)
                continue
            joined = None
            for i in held.alike(own) if held.names else ():
                if held.label[i] != joined:
                    if held.names[i] != fp:
                        u.append(held.names[i])
                        v.append(fp)
                    if joined is not None:
                        held.label = [held.label[i] if x == joined else x for x in held.label]
                    joined = held.label[i]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    del held
    returned()


def candidates(points: DataFrame) -> DataFrame:
    """``u, v``: links between points of a common band, and between those whose SimHashes are linked."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select(F.explode("bands").alias("band"), "fp").repartition(parts, "band").sortWithinPartitions("band", "fp")
    least = stored(points.filter("sim IS NOT NULL").groupBy("sim").agg(F.min("fp").alias("least")), "sims")
    close = simhash.links(least.select(F.col("sim").alias("fp")))
    near = close.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    equal = points.select("sim", "fp").join(least, "sim").filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return dealt.mapInArrow(_starred, "u long, v long").unionByName(near).unionByName(equal).distinct()


def _chunks(count: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / CELL), F.ceil(F.col(shingles) / SHINGLES), F.lit(1)).cast("long")


def _own(chunks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col(chunks))


def _meeting(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Links within ``group, cell, side, fp``."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(texts, "fp").select("group", "cell", "side", "fp", "text").repartition(parts, "group", "cell").sortWithinPartitions("group", "cell", "side")
    return dealt.mapInArrow(_compared, "u long, v long").distinct()


def edge_cells(edges: DataFrame) -> DataFrame:
    """Cells of candidate pairs ``u, v``: each ``u`` meets its others, by chunks of these."""
    sized = edges.groupBy(F.col("u").alias("group")).agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / CELL).cast("long"))
    others = edges.select(F.col("u").alias("group"), F.col("v").alias("fp")).join(sized, "group").select("group", _own("chunks").alias("cell"), F.lit(1).alias("side"), "fp")
    return others.unionByName(others.select("group", "cell", F.lit(0).alias("side"), F.col("group").alias("fp")).distinct())


def band_cells(points: DataFrame, linked: DataFrame) -> DataFrame:
    """Cells of bands whose points, but for the leader, aren't all linked by ``linked(node, root)``: those outside the largest group of linked points meet all."""
    rooted = points.join(linked, points["fp"] == linked["node"], "left").select("fp", "size", "bands", F.coalesce("root", F.xxhash64("fp")).alias("root"))
    by_band = rooted.select(F.explode("bands").alias("group"), "fp", "size", "root")
    leaders = by_band.groupBy("group").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    rest = stored(by_band.join(leaders.drop("n"), "group").filter("fp <> leader").drop("leader"), "rest")
    per_root = rest.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    largest = F.max(F.struct("n", "root")).alias("largest")
    mixed = per_root.groupBy("group").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), largest, F.max_by("shingles", F.struct("n", "root")).alias("most")).filter("roots > 1")
    outside = mixed.select("group", F.col("largest.root").alias("most_root"), (F.col("n") - F.col("largest.n")).alias("few"), (F.col("shingles") - F.col("most")).alias("few_shingles"), "n", "shingles")
    chunked = outside.select("group", "most_root", _chunks("few", "few_shingles").alias("held"), _chunks("n", "shingles").alias("passing"))
    met = rest.join(chunked, "group")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    few = met.filter("root <> most_root").select("group", F.explode(F.transform(every("passing"), lambda j: _own("held") * F.col("passing") + j)).alias("cell"), F.lit(0).alias("side"), "fp")
    all_ = met.select("group", F.explode(F.transform(every("held"), lambda i: i * F.col("passing") + _own("passing"))).alias("cell"), F.lit(1).alias("side"), "fp")
    return few.unionByName(all_)


def links(docs: DataFrame, points: DataFrame) -> DataFrame:
    """``u, v``: links that connect what all candidates of at least ``LIKE`` connect."""
    edges = stored(candidates(points), "candidates")
    ends = edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    wanted = points.join(ends, "fp", "left_semi").select("fp", "first.*")
    rows = docs.select(*row_key(), F.col("text").cast("string").alias("text")).join(wanted, ["no_id", "id", "of_text"])
    texts = stored(rows.select("fp", "text").dropDuplicates(["fp"]), "texts", **{"parquet.block.size": TEXT_BLOCK})
    first = stored(_meeting(texts, edge_cells(edges)), "links")
    second = stored(_meeting(texts, band_cells(points, connected_components(first))), "links")
    discard(edges, texts)
    return first.unionByName(second)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The row of one document of each group of near copies, that of the smallest id, in all its columns."""
    marked = bounded(docs).select(*row_key(), F.col("text").cast("string").alias("text")).mapInArrow(_marked, "no_id boolean, id long, of_text long, fp long, sim long, bands array<long>, size long")
    points = stored(marked.groupBy("fp").agg(F.min(F.struct("no_id", "id", "of_text")).alias("first"), F.first("sim").alias("sim"), F.first("bands").alias("bands"), F.first("size").alias("size")), "points")
    return one_of_each(docs, points.select("fp", "first"), links(docs, points))
