"""One linear classifier per concept against a control, and what they score.

A concept's rows and the control's meet in one group per concept: ``per_concept`` rows of each, the first
in hash order, as the classifier's sample size is a parameter; so no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.hashing import shuffle_key
from larkspur.operators.relational import first_n, split_by_hash
from larkspur.sources.storage import stored

SCHEMA = "concept string, w array<double>, bias double, fscore double, fscore_macro double, accuracy double, train_fscore double, train_accuracy double, decay double"
#: Decays that are tried.
DECAYS = {"adamw": (1e-2, 1e-4, 1e-6), "l2": (1e-2, 1e-4, 1e-6, 1e-8), "l1": (1e-1, 1.0)}


def drawn(rows: DataFrame, per_concept: int, seed: str = "42") -> DataFrame:
    """Rows of ``concept, id`` that a classifier's samples are made of: the first of each concept in hash order."""
    return first_n(rows.withColumn("order_key", shuffle_key(seed, F.col("id"))), "concept", "order_key", per_concept).drop("nth", "order_key")


def samples_for(rows: DataFrame, control: str, per_concept: int, seed: str = "42") -> DataFrame:
    """``concept, id, emb, truth, split``: each concept (truth 0) with the control (truth 1), split 9 to 1."""
    keyed = drawn(rows, per_concept, seed)
    shared = keyed.filter(F.col("concept") == control).drop("concept")
    names = keyed.select("concept").filter(F.col("concept") != control).distinct()
    both = keyed.filter(F.col("concept") != control).withColumn("truth", F.lit(0)).unionByName(names.join(shared).withColumn("truth", F.lit(1)))
    return split_by_hash(both.withColumn("class", F.concat_ws(":", "concept", "truth")), "class", F.col("id"), 0.1, seed).drop("class")


def samples_for_pairs(rows: DataFrame, pairs: DataFrame, per_concept: int, seed: str = "42") -> DataFrame:
    """``concept, id, emb, truth, split`` with a control of its own for each concept: ``pairs(concept, control)``."""
    keyed = stored(drawn(rows, per_concept, seed).select("concept", "id", "emb"), "samples")
    own = keyed.join(pairs.select("concept"), "concept", "left_semi").withColumn("truth", F.lit(0))
    other = keyed.withColumnRenamed("concept", "control").join(pairs.select("concept", "control"), "control").select("concept", "id", "emb", F.lit(1).alias("truth"))
    both = own.unionByName(other)
    return split_by_hash(both.withColumn("class", F.concat_ws(":", "concept", "truth")), "class", F.col("id"), 0.1, seed).drop("class")


def adamw(x: np.ndarray, sign: np.ndarray, decay: float, rate: float = 0.01, batch: int = 32, epochs: int = 1000, patience: int = 10) -> tuple[np.ndarray, float]:
    """Weights (the last one a bias) by AdamW on the mean hinge loss, and that loss of the rows held out.

    A tenth of the rows is held out; the others come in batches in a new order each epoch. Descent ends when the loss held out hasn't fallen for
    ``patience`` epochs, and the weights of the best epoch are returned.
    """
    rng = np.random.default_rng([len(x), x.shape[1]])
    x = np.column_stack([x, np.ones(len(x))])
    order = rng.permutation(len(x))
    held, rest = order[: max(1, len(x) // 10)], order[max(1, len(x) // 10) :]
    rest = rest if len(rest) else held
    w, m, v, t = np.zeros(x.shape[1]), 0.0, 0.0, 0
    best, kept, since = np.inf, w, 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for some in (rest[i : i + batch] for i in range(0, len(rest), batch)):
            t += 1
            wrong = some[sign[some] * (x[some] @ w) < 1]
            g = -(sign[wrong, None] * x[wrong]).sum(axis=0) / len(some)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss = float(np.maximum(1 - sign[held] * (x[held] @ w), 0).mean())
        best, kept, since = (loss, w, 0) if loss < best else (best, kept, since + 1)
        if since >= patience:
            break
    return kept, best


def sgd(x: np.ndarray, sign: np.ndarray, decay: float, penalty: str = "l2", epochs: int = 100, patience: int = 5, batch: int = 16) -> np.ndarray:
    """Weights (the last one a bias) by averaged stochastic descent on the hinge loss with an l2 or l1 penalty.

    A tenth of the rows is held out; descent ends when their accuracy hasn't risen for ``patience`` epochs, and the averaged weights of the best
    epoch are returned.
    """
    rng = np.random.default_rng([len(x), x.shape[1]])
    x = np.column_stack([x, np.ones(len(x))])
    order = rng.permutation(len(x))
    held, rest = order[: max(1, len(x) // 10)], order[max(1, len(x) // 10) :]
    w, mean, seen, since = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    best, kept = -1.0, mean
    start = 1.0 / max(1e-3, float((x * x).sum(axis=1).mean()))
    for _ in range(epochs):
        rng.shuffle(rest)
        for some in (rest[i : i + batch] for i in range(0, len(rest), batch)):
            rate = start / (1 + start * decay * seen)
            wrong = some[sign[some] * (x[some] @ w) < 1]
            w = w + rate * (sign[wrong, None] * x[wrong]).sum(axis=0) / len(some)
            if penalty == "l2":
                w[:-1] *= max(0.0, 1 - rate * decay)
            else:
                w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * decay, 0)
            seen += 1
            mean = mean + (w - mean) / seen
        right = float((np.sign(x[held] @ mean) == sign[held]).mean())
        best, kept, since = (right, mean, 0) if right > best else (best, kept, since + 1)
        if since >= patience:
            break
    return kept


def _f1(pred: np.ndarray, truth: np.ndarray, cls: int) -> float:
    both = ((pred == cls) & (truth == cls)).sum()
    return float(2 * both / max(1, (pred == cls).sum() + (truth == cls).sum()))


def train(samples: DataFrame, method: str = "adamw", decays: tuple[float, ...] | None = None, folds: int = 5) -> DataFrame:
    """``concept, w, bias, fscore, ...``: weights point to the concept; the decay is chosen by cross-validation on accuracy, for ``adamw`` by the loss held out.

    ``method`` is ``adamw``, or ``l2`` or ``l1`` for averaged stochastic descent with that penalty. ``fscore`` is that of
    the control's class, ``fscore_macro`` the mean over both, on the test split; ``train_*`` are those of the training split.
    """
    grid = DECAYS[method] if decays is None else decays

    def weights(x: np.ndarray, sign: np.ndarray, decay: float, short: bool = False) -> np.ndarray:
        return sgd(x, sign, decay, method, 30 if short else 100)

    def measured(x: np.ndarray, truth: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
        pred = (x @ w[:-1] + w[-1] <= 0).astype(int)
        f = [_f1(pred, truth, c) for c in (0, 1)]
        return f[1], sum(f) / 2, float((pred == truth).mean()) if len(truth) else 0.0

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["split", "truth", "id"])
        x, truth = np.array(part.emb.tolist(), float), part.truth.to_numpy()
        sign, test = np.where(truth == 0, 1.0, -1.0), (part.split == "test").to_numpy()
        fold = np.arange(len(part)) % folds

        def held(decay: float, k: int) -> float:
            use, out = ~test & (fold != k), ~test & (fold == k)
            w = weights(x[use], sign[use], decay, True)
            return float((np.sign(x[out] @ w[:-1] + w[-1]) == sign[out]).mean()) if out.any() and use.any() else 0.0

        if method == "adamw":
            tried = {d: adamw(x[~test], sign[~test], d) for d in grid}
            best = min(grid, key=lambda d: tried[d][1])
            w = tried[best][0]
        else:
            best = max(grid, key=lambda d: np.mean([held(d, k) for k in range(folds)])) if len(grid) > 1 else grid[0]
            w = weights(x[~test], sign[~test], best)
        f, macro, accuracy = measured(x[test], truth[test], w)
        own, _, fitted = measured(x[~test], truth[~test], w)
        return pd.DataFrame({"concept": [part.concept.iloc[0]], "w": [w[:-1]], "bias": [w[-1]], "fscore": [f], "fscore_macro": [macro], "accuracy": [accuracy], "train_fscore": [own], "train_accuracy": [fitted], "decay": [best]})

    return samples.groupBy("concept").applyInPandas(one, SCHEMA)


def dot(a: str, b: str):
    """Inner product of two array columns, in the JVM."""
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scores(attributions: DataFrame, cavs: DataFrame) -> DataFrame:
    """Every attribution against every direction; directions are few (one per concept) and broadcast."""
    return attributions.crossJoin(F.broadcast(cavs.select("concept", "w"))).select("concept", "id", dot("a", "w").alias("score"))


def cosine(rows: DataFrame) -> DataFrame:
    """``a, b, cosine`` of all pairs of ``concept, w``: concepts are few."""
    norm = rows.select("concept", "w", F.sqrt(dot("w", "w")).alias("n"))
    left, right = norm.toDF("a", "wa", "na"), norm.toDF("b", "wb", "nb")
    return left.crossJoin(F.broadcast(right)).select("a", "b", (dot("wa", "wb") / (F.col("na") * F.col("nb"))).alias("cosine"))
