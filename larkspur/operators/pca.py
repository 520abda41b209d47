"""Standardisation, principal components and subspaces of activation vectors.

Vectors come as ``id, vector``. Those that are null, hold null or non-finite components or have another length than most take no part;
without any, a model has no dimensions. Means and deviations are put together from those of partitions. Components come from a tall-skinny QR: each
partition keeps the triangular factor of its standardised vectors, so squares are never formed and small components keep their digits. Factors
are merged in rounds of at most ``FAN`` in one task, the last round on the driver; rows never move. For more dimensions than a
square matrix can have, ``fit_wide`` finds the leading components by a randomised range finder with factors of (dimensions x components).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.vectors import sound
from larkspur.sources.storage import discard, stored

#: Factors that one task merges, and partitions that have factors.
FAN, LEAVES = 8, 4_096


class Model(NamedTuple):
    mean: np.ndarray
    std: np.ndarray  # -1 where a dimension is constant
    components: np.ndarray  # k by dimensions, orthonormal rows
    variances: np.ndarray  # of all components (of the k that were looked for, if fitted by fit_wide), falling


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _doubles(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Vectors that take part, in double precision; of the given length, or of that of most."""
    doubles = rows.select("id", F.col("vector").cast("array<double>").alias("vector"))
    return sound(doubles, "vector", size)


def in_rounds(rows: DataFrame, partial: Callable[[Iterator[np.ndarray]], list[np.ndarray] | None], merge: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """One list of arrays from those of all partitions of ``vector``; no task, nor the driver, holds more than FAN lists. None without rows.

    ``partial`` makes a list from a partition's matrices, ``merge`` one from several.
    """
    schema = "node long, parts array<binary>, shapes array<array<int>>"

    def packed(node: int, parts: list[np.ndarray]) -> dict:
        return {"node": [node], "parts": [[np.ascontiguousarray(x, float).tobytes() for x in parts]], "shapes": [[list(x.shape) for x in parts]]}

    def unpacked(parts: list[bytes], shapes: list[list[int]]) -> list[np.ndarray]:
        return [np.frombuffer(x).reshape(s) for x, s in zip(parts, shapes)]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(_matrix(b.column("vector")) for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_pydict(packed(0, found), pa.schema([("node", pa.int64()), ("parts", pa.list_(pa.binary())), ("shapes", pa.list_(pa.list_(pa.int32())))]))

    def branch(part: pa.Table) -> pa.Table:
        lists = [unpacked(p.as_py(), s.as_py()) for p, s in zip(part.column("parts"), part.column("shapes"))]
        return pa.table(packed(part.column("node")[0].as_py() // FAN, merge(lists)), pa.schema([("node", pa.int64()), ("parts", pa.list_(pa.binary())), ("shapes", pa.list_(pa.list_(pa.int32())))]))

    leaves = rows.select("vector").coalesce(LEAVES).mapInArrow(leaf, schema).withColumn("node", F.spark_partition_id().cast("long"))
    last = leaves.limit(FAN + 1).collect()  # of few partitions these are all; of many, only some are read for this
    if len(last) > FAN:
        level = stored(leaves, "factors")
        while len(last := level.limit(FAN + 1).collect()) > FAN:
            above = stored(level.groupBy(F.expr(f"node DIV {FAN}").alias("above")).applyInArrow(branch, schema), "factors")
            discard(level)
            level = above
        discard(level)
    return merge([unpacked(r.parts, r.shapes) for r in last]) if last else None


def _moments(x: Iterator[np.ndarray]) -> list[np.ndarray] | None:
    found = [[np.array([len(m)]), m.mean(axis=0), ((m - m.mean(axis=0)) ** 2).sum(axis=0)] for m in x]
    return _together(found) if found else None


def _together(lists: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Numbers, means and sums of squares about the mean of several sets of rows, as one."""
    (n, mean, squares), *others = lists
    for k, m, q in others:
        squares = squares + q + (m - mean) ** 2 * (n * k / (n + k))
        mean, n = mean + (m - mean) * (k / (n + k)), n + k
    return [n, mean, squares]


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def standard(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, DataFrame]:
    """Number, means and deviations of the vectors that take part, and these vectors."""
    taking_part = _doubles(rows)
    found = in_rounds(taking_part, _moments, _together)
    if found is None:
        return 0, np.zeros(0), np.zeros(0), taking_part
    n, mean, squares = found
    std = np.sqrt(squares / max(1, n[0] - 1))
    return int(n[0]), mean, np.where(std <= 1e-12 * np.maximum(1, np.abs(mean)), -1.0, std), taking_part


def factor(vectors: DataFrame, mean: np.ndarray, std: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of the standardised vectors, or of their coordinates on ``axes`` (columns)."""

    def partial(x: Iterator[np.ndarray]) -> list[np.ndarray] | None:
        r = None
        for m in x:
            z = np.where(std == -1, 0.0, (m - mean) / std)
            z = z if axes is None else z @ axes
            r = _triangle(z if r is None else np.vstack([r, z]))
        return None if r is None else [r]

    found = in_rounds(vectors, partial, lambda lists: [_triangle(np.vstack([r for [r] in lists]))])
    return np.zeros((0, len(mean) if axes is None else axes.shape[1])) if found is None else found[0]


def _signed(components: np.ndarray) -> np.ndarray:
    """The largest coordinate of each component is positive."""
    if not components.size:
        return components
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return components * np.where(signs == 0, 1, signs)[:, None]


def fit(rows: DataFrame, components: int | None = None) -> Model:
    """Of standardised vectors; ``None`` keeps all components, 0 none. The largest coordinate of a component is positive."""
    n, mean, std, vectors_ = standard(rows)
    r = factor(vectors_, mean, std) if n else np.zeros((0, 0))
    _, values, vectors = np.linalg.svd(r, full_matrices=True)
    variances = np.zeros(len(mean))
    variances[: len(values)] = values**2 / max(1, n - 1)
    kept = _signed(vectors)
    return Model(mean, std, kept if components is None else kept[:components], variances)


def fit_wide(rows: DataFrame, components: int, more: int = 8, passes: int = 2, seed: int = 1) -> Model:
    """The leading components of vectors of very many dimensions; no matrix has more than dimensions x (components + ``more``) numbers.

    Random axes are turned towards the leading components by ``passes`` products with the standardised vectors and their transpose; the
    factor of the vectors' coordinates on them then gives the components.
    """
    n, mean, std, vectors_ = standard(rows)
    if not n:
        return Model(mean, std, np.zeros((0, 0)), np.zeros(0))
    wide = min(len(mean), components + more)
    axes, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), wide)))
    for _ in range(passes):
        held = axes

        def partial(x: Iterator[np.ndarray], held: np.ndarray = held) -> list[np.ndarray] | None:
            total = None
            for m in x:
                z = np.where(std == -1, 0.0, (m - mean) / std)
                total = z.T @ (z @ held) if total is None else total + z.T @ (z @ held)
            return None if total is None else [total]

        [turned] = in_rounds(vectors_, partial, lambda lists: [np.sum([t for [t] in lists], axis=0)])
        axes, _ = np.linalg.qr(turned)
    _, values, vectors = np.linalg.svd(factor(vectors_, mean, std, axes), full_matrices=False)
    kept = min(components, len(values))
    return Model(mean, std, _signed(vectors[:kept] @ axes.T), values[:kept] ** 2 / max(1, n - 1))


def correlation(rows: DataFrame) -> np.ndarray:
    """Of all dimensions with each other; 0 for constant ones."""
    n, mean, std, vectors_ = standard(rows)
    r = factor(vectors_, mean, std) if n else np.zeros((0, 0))
    return r.T @ r / max(1, n - 1)


def variance_explained(model: Model) -> np.ndarray:
    return model.variances / (model.variances.sum() or 1.0)


def project(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Projections and residuals of the standardised vectors."""
    z = (x - model.mean) / model.std
    p = z @ model.components.T
    return p, z - p @ model.components


def embed(rows: DataFrame, model: Model) -> DataFrame:
    """``id, emb``: projections, then residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(project(_matrix(batch.column("vector")), model), axis=1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(both), pa.list_(pa.float64()))], names=["id", "emb"])

    return _doubles(rows, len(model.mean)).mapInArrow(run, "id long, emb array<double>")


def restore(embedded: np.ndarray, model: Model) -> np.ndarray:
    """Vectors from their embeddings."""
    k = len(model.components)
    return (embedded[:, :k] @ model.components + embedded[:, k:]) * model.std + model.mean


def subspace(directions: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """An orthonormal basis (columns) of what the directions (rows) span."""
    u, s, _ = np.linalg.svd(directions.T, full_matrices=False)
    return u[:, s > tolerance * max(1.0, s[0] if len(s) else 0)]


def restored(embedded: DataFrame, model: Model) -> DataFrame:
    """``id, vector`` of ``id, emb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = restore(_matrix(batch.column("emb")), model) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(back), pa.list_(pa.float64()))], names=["id", "vector"])

    return embedded.select("id", F.col("emb").cast("array<double>").alias("emb")).mapInArrow(run, "id long, vector array<double>")


def _merges(similarity: np.ndarray) -> list[tuple[float, int, int]]:
    """Average linkage of a similarity matrix, by nearest-neighbour chains: distance and smallest members of the two clusters of each merge, by distance.

    A chain follows nearest neighbours until two are each other's; these are merged, and the rest of the chain stays valid. Every cluster
    enters a chain a bounded number of times, so the work is the square of the number, not its cube.
    """
    n = len(similarity)
    distance = 1 - similarity.astype(float)
    np.fill_diagonal(distance, np.inf)
    size, live, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            row = distance[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        b, a = sorted((chain.pop(), chain.pop()), reverse=True)
        found.append((float(distance[a, b]), a, b))
        merged = (size[a] * distance[a] + size[b] * distance[b]) / (size[a] + size[b])
        merged[[a, b]] = np.inf
        merged[~live] = np.inf
        distance[a], distance[:, a] = merged, merged
        distance[b], distance[:, b] = np.inf, np.inf
        size[a] += size[b]
        live[b] = False
    return sorted(found)


def _joined(n: int, merges: list[tuple[float, int, int]]) -> list[list[int]]:
    """The clusters after these merges: the leaves of the first of two, then those of the second."""
    leaves = {i: [i] for i in range(n)}
    for _, a, b in merges:
        a, b = (next(k for k, v in leaves.items() if x in v) if x not in leaves else x for x in (a, b))
        low, high = min(a, b), max(a, b)
        leaves[low] = leaves[low] + leaves.pop(high)
    return list(leaves.values())


def average_linkage_order(similarity: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering of a small similarity matrix (concepts by concepts)."""
    return [i for own in _joined(len(similarity), _merges(similarity)) for i in own]


def clusters(similarity: np.ndarray, most: int) -> list[int]:
    """Cluster numbers from 0, by smallest member, when average linkage has come down to ``most`` clusters."""
    groups = _joined(len(similarity), _merges(similarity)[: max(0, len(similarity) - most)])
    number = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [number[i] for i in range(len(similarity))]
