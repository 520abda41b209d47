"""Arrow batches of bounded size for functions over whole texts."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a function holds at once, but for a single longer text.
TEXT_BYTES = 4 << 20


#: Bytes of an Arrow batch between the JVM and a Python worker; both hold some at a time.
BATCH_BYTES = 4 << 20
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches have at most BATCH_BYTES, or one row.

    A lower limit of the session's own stays.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)([bkmg]?)b?", conf.get(name).lower()).groups()
    if not 0 < int(number) * _UNITS[unit or "b"] <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return rows


@functools.cache
def _trim():
    """glibc's function that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: None


def returned() -> None:
    """Give back what this worker has freed; it lives on, beside others, after its task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts together have at most ``limit`` bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            returned()
