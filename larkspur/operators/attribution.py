"""Layer outputs and attributions of a small network, in Arrow batches.

The network is a list of layers, each from flat vectors to flat vectors: dense ones, 1-D convolutions and max pooling, with rectifiers after
every dense layer and convolution but the last; it is a parameter, sent to every task. Inputs are vectors (``vector``), or sequences (``seq``) that
become four channels of 0 and 1. Multipliers follow the rescale rule: a rectifier passes the ratio of the differences of its outputs
and inputs between a sample and its baseline, and a window of pooling passes all of its difference to the place that holds the larger of the two
maxima. So attributions add up to the difference of the outputs, through every kind of layer.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.pca import Model, project, restore
from larkspur.operators.sequences import Letters

#: Numbers that a layer's inputs and outputs may have in a batch; some forty arrays of that many live at once.
AT_ONCE = 1 << 19


class Dense(NamedTuple):
    weight: np.ndarray  # inputs by outputs
    bias: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def back(self, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return m @ self.weight.T

    def widest(self) -> int:
        return max(self.weight.shape)


class Convolution(NamedTuple):
    weight: np.ndarray  # outputs by channels by width
    bias: np.ndarray
    length: int  # of the inputs

    def _windows(self, x: np.ndarray) -> Iterator[tuple[int, slice]]:
        out = self.length - self.weight.shape[2] + 1
        return ((i, slice(i, i + out)) for i in range(self.weight.shape[2]))

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), self.weight.shape[1], self.length)
        return sum(self.weight[:, :, i] @ x[:, :, s] for i, s in self._windows(x)).reshape(len(x), -1) + np.repeat(self.bias, self.length - self.weight.shape[2] + 1)

    def back(self, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, out = m.reshape(len(m), self.weight.shape[0], -1), np.zeros((len(m), self.weight.shape[1], self.length))
        for i, s in self._windows(m):
            out[:, :, s] += self.weight[:, :, i].T @ m
        return out.reshape(len(m), -1)

    def widest(self) -> int:
        return self.length * max(self.weight.shape[:2])


class MaxPool(NamedTuple):
    channels: int
    length: int  # of the inputs
    width: int
    stride: int

    def _windows(self, x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), self.channels, self.length), self.width, axis=2)[:, :, :: self.stride]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._windows(x).max(axis=3).reshape(len(x), -1)

    def back(self, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wa, wb = self._windows(a), self._windows(b)
        n, c, p = wa.shape[:3]
        top_a, top_b = wa.max(axis=3), wb.max(axis=3)
        place = np.where(top_a >= top_b, wa.argmax(axis=3), wb.argmax(axis=3)) + np.arange(p) * self.stride
        index = (np.arange(n)[:, None, None] * c + np.arange(c)[:, None]) * self.length + place
        d_in = a.ravel()[index] - b.ravel()[index]
        slope = np.where(np.abs(d_in) > 1e-9, (top_a - top_b) / np.where(d_in == 0, 1, d_in), 1.0)
        out = np.bincount(index.ravel(), weights=(m.reshape(n, c, p) * slope).ravel(), minlength=a.size)
        return out.reshape(a.shape)

    def widest(self) -> int:
        return self.channels * self.length * max(1, self.width // self.stride)


Layer = Dense | Convolution | MaxPool


def load_layers(spark: SparkSession, path: str) -> list[Layer]:
    """A network from an .npz file, by any path that Spark can read.

    Layer i has ``weight{i}`` and ``bias{i}``, and with ``length{i}`` is a convolution; or ``pool{i}``: channels, length, width, stride.
    """
    held = np.load(io.BytesIO(spark.read.format("binaryFile").load(path).select("content").first().content), allow_pickle=False)
    layers: list[Layer] = []
    while True:
        i = len(layers)
        if f"pool{i}" in held:
            layers.append(MaxPool(*map(int, held[f"pool{i}"])))
        elif f"length{i}" in held:
            layers.append(Convolution(held[f"weight{i}"].astype(float), held[f"bias{i}"].astype(float), int(held[f"length{i}"])))
        elif f"weight{i}" in held:
            layers.append(Dense(held[f"weight{i}"].astype(float), held[f"bias{i}"].astype(float)))
        else:
            return layers


def rectified(layers: list[Layer], i: int) -> bool:
    return i < len(layers) - 1 and not isinstance(layers[i], MaxPool)


def forward(x: np.ndarray, layers: list[Layer]) -> list[np.ndarray]:
    """Inputs of every layer, and last the output."""
    seen = [x]
    for i, layer in enumerate(layers):
        x = layer.apply(seen[-1])
        seen.append(np.maximum(x, 0) if rectified(layers, i) else x)
    return seen


def backward(m: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], layers: list[Layer], top: int, bottom: int = 0) -> np.ndarray:
    """Multipliers of the inputs of layer ``bottom`` from those of layer ``top``."""
    for i in reversed(range(bottom, top)):
        if rectified(layers, i):
            before = [layers[i].apply(s[i]) for s in (a, b)]
            d_in, d_out = before[0] - before[1], a[i + 1] - b[i + 1]
            m = m * np.where(np.abs(d_in) > 1e-9, d_out / np.where(d_in == 0, 1, d_in), (before[0] > 0).astype(float))
        m = layers[i].back(m, a[i], b[i])
    return m


def multipliers(x: np.ndarray, base: np.ndarray, layers: list[Layer]) -> np.ndarray:
    """Rescale multipliers of the first output with respect to the inputs."""
    a, b = forward(x, layers), forward(base, layers)
    return backward(first_output(a), a, b, layers, len(layers))


def first_output(seen: list[np.ndarray]) -> np.ndarray:
    m = np.zeros(seen[-1].shape)
    m[:, 0] = 1
    return m


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def one_hot(seqs: pa.Array, length: int) -> np.ndarray:
    """Four channels (A, C, G, T) of 0 and 1, flat; other letters and what is missing at the end are 0 in all, longer sequences an error."""
    letters = Letters.of(seqs)
    if (letters.sizes > length).any():
        raise ValueError(f"a sequence of more than {length} letters")
    code = np.full(256, 4)
    code[list(b"ACGT")] = range(4)
    out, row = np.zeros((len(seqs), 5, length)), np.repeat(np.arange(len(seqs)), letters.sizes)
    out[row, code[letters.flat], np.arange(len(letters.flat)) - letters.starts[row]] = 1
    return out[:, :4].reshape(len(seqs), -1)


def inputs(column: pa.Array, layers: list[Layer]) -> np.ndarray:
    """Vectors as they are, sequences as the channels of the first layer, a convolution or a dense one."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return _arrays(column)
    first = layers[0]
    return one_hot(column, first.length if isinstance(first, Convolution) else len(first.weight) // 4)


def _slices(batches: Iterator[pa.RecordBatch], layers: list[Layer]) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows for the widest layer."""
    rows = max(1, AT_ONCE // max(x.widest() for x in layers)) if layers else 1 << 30
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _read(rows: DataFrame, *names: str) -> DataFrame:
    """``id`` and the named columns: sequences as they are, vectors in double precision."""
    kinds = dict(rows.dtypes)
    return rows.select("id", *[F.col(c) if kinds[c] == "string" else F.col(c).cast("array<double>").alias(c) for c in names])


def layer_output(rows: DataFrame, layers: list[Layer], upto: int) -> DataFrame:
    """``id, vector`` after ``upto`` layers, from ``id`` and ``vector`` or ``seq``."""
    name = "vector" if "vector" in rows.columns else "seq"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, layers):
            out = forward(inputs(batch.column(name), layers), layers)[upto]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "vector"])

    return _read(rows, name).mapInArrow(run, "id long, vector array<double>")


def layer_attributions(pairs: DataFrame, layers: list[Layer], model: Model, absolute: bool = True, times_difference: bool = True) -> DataFrame:
    """``id, a`` of ``id, vector, base``: multipliers in the space of projections and residuals, times the
    (absolute) difference of sample and baseline there, unless only multipliers are asked for."""
    lift = np.concatenate([model.components, np.eye(len(model.mean))]) * model.std  # embeddings to vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, layers):
            x, b = _arrays(batch.column("vector")), _arrays(batch.column("base"))
            ex, eb = (np.concatenate(project(v, model), axis=1) for v in (x, b))
            m = multipliers(restore(ex, model), restore(eb, model), layers) @ lift.T
            d = (np.abs(ex - eb) if absolute else ex - eb) if times_difference else 1.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(m * d), pa.list_(pa.float64()))], names=["id", "a"])

    return _read(pairs, "vector", "base").mapInArrow(run, "id long, a array<double>")


def split_by_subspace(attributions: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of attributions within a subspace and outside it."""
    inside = attributions @ basis @ basis.T
    return inside, attributions - inside


def patched_output(embedded: DataFrame, layers: list[Layer], upto: int, model: Model) -> DataFrame:
    """``id, output`` of the network if the output of its first ``upto`` layers is replaced by what ``id, emb`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = forward(restore(_arrays(batch.column("emb")), model), layers[upto:])[-1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[:, 0])], names=["id", "output"])

    return embedded.select("id", F.col("emb").cast("array<double>").alias("emb")).mapInArrow(run, "id long, output double")


def input_attributions(pairs: DataFrame, layers: list[Layer], upto: int, model: Model | None = None, basis: np.ndarray | None = None, part: str = "all") -> DataFrame:
    """``id, a, difference``: multipliers of the inputs times the difference of sample and baseline, and the difference of their outputs.

    Of ``id, vector, base``, or ``id, seq, base`` with sequences; then ``a`` has a number per letter. Of the multipliers at the output of the first
    ``upto`` layers, seen as embeddings, only the part ``inside`` the subspace of
    ``basis`` (columns) or ``outside`` it is passed on; both parts add up to ``all``, and that to the difference.
    """
    if part not in ("all", "inside", "outside"):
        raise ValueError("part is all, inside or outside")
    if part != "all":
        lift = np.concatenate([model.components, np.eye(len(model.mean))]) * model.std  # embeddings to vectors
        embed = np.concatenate([model.components.T, np.eye(len(model.mean)) - model.components.T @ model.components], axis=1) / model.std[:, None]
    name = "vector" if "vector" in pairs.columns else "seq"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, layers):
            x, base = inputs(batch.column(name), layers), inputs(batch.column("base"), layers)
            a, b = forward(x, layers), forward(base, layers)
            m = backward(first_output(a), a, b, layers, len(layers), upto)
            if part != "all":
                inside, outside = split_by_subspace(m @ lift.T, basis)
                m = (inside if part == "inside" else outside) @ embed.T
            each = backward(m, a, b, layers, upto) * (x - base)
            each = each.reshape(len(x), 4, -1).sum(axis=1) if name == "seq" else each
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(each), pa.list_(pa.float64())), pa.array(a[-1][:, 0] - b[-1][:, 0])], names=["id", "a", "difference"])

    return _read(pairs, name, "base").mapInArrow(run, "id long, a array<double>, difference double")
