"""Counter-based randomness: the same numbers on any cluster, and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the key's parts, joined by ``:``."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def shuffle_key(*key: Column | str) -> Column:
    """A random order that depends on nothing but the key."""
    return F.md5(F.concat_ws(":", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]))


def uniform_sql(*key: str) -> str:
    """``uniform`` for DuckDB; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def counted(seed: int, keys: np.ndarray, *counters: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for whole arrays of row keys within a task: the same for a key and counters, whatever stands beside it."""
    with np.errstate(over="ignore"):
        x = _stirred(np.asarray(keys, np.int64).view(np.uint64) + np.uint64(seed % (1 << 64)))
        for c in counters:
            x = _stirred(x + np.asarray(c, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
