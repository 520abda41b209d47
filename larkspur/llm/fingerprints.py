"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``K`` smallest distinct 64-bit hashes of a text's shingles of ``WORDS`` words (lower-cased,
split at white space; a shorter text is one shingle, a text without words has none). Sketches of
parts merge into that of the whole: the ``K`` smallest of both. They estimate resemblance (Jaccard),
containment and the number of distinct shingles, exactly where a text has at most ``K``.

Edge cases: null texts are empty; two texts without shingles have likeness 1, one of them and another
text 0; equal texts have equal sketches. Whole texts are hashed, in batches of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, text_slices
from larkspur.sources.storage import table

#: Hashes of a sketch: estimates of a resemblance have a standard error of 0.044 at most.
K = 128
WORDS = 5
#: Rows of a bucket of neighbouring documents, on average, and the most buckets there are; their bounds
#: (8 bytes each) are sent to every task. Beyond, buckets grow and are still streamed.
BUCKET_ROWS, MAX_BUCKETS = 2_048, 16_384
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sorted sketch of every text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(flat, "")
    flat, parents = flat.filter(real), parents[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    of_word = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    lengths = np.bincount(parents, minlength=len(texts)) if len(flat) else np.zeros(len(texts), np.int64)
    begins = np.cumsum(lengths) - lengths
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            rolled += hashes[i : i + n] * _FACTORS[i]
        rolled = _mixed(rolled)
        out = []
        for a, m in zip(begins.tolist(), lengths.tolist()):
            if m >= words:
                own = rolled[a : a + m - words + 1]
            elif m:
                own = _mixed((hashes[a : a + m] * _FACTORS[:m]).sum(keepdims=True, dtype=np.uint64) + np.uint64(m))
            else:
                own = hashes[:0]
            out.append(np.unique(own)[:k])
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity: the share of the union's smallest hashes that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = merged(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of ``a``'s distinct shingles that ``b`` has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k))


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, distinct_shingles`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            made = sketches(part.column("text"), k, words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(written, made), pa.string()), pa.array([distinct_shingles(x, k) for x in made], pa.float64())], names=["doc_id", "fingerprint", "distinct_shingles"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merged_by(rows: DataFrame, group: str, k: int = K) -> DataFrame:
    """``group, fingerprint, distinct_shingles`` of each group's documents taken together.

    Rows are merged within their partitions first, so a group has at most a row per partition to shuffle.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([written(x) for x in held.values()], pa.string())], names=["key", "fingerprint"])
            held.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist()):
                held[key] = merged(held[key], read(text), k) if key in held else read(text)
            if len(held) > 20_000:
                yield out()
        yield out()

    def final(part: pa.Table) -> pa.Table:
        whole = np.zeros(0, np.uint64)
        for text in part.column("fingerprint").to_pylist():
            whole = merged(whole, read(text), k)
        return pa.table({group: part.column("key").slice(0, 1), "fingerprint": [written(whole)], "distinct_shingles": [distinct_shingles(whole, k)]})

    keyed = rows.select(F.col(group).cast("string").alias("key"), "fingerprint").mapInArrow(partial, "key string, fingerprint string")
    return keyed.groupBy("key").applyInArrow(final, f"`{group}` string, fingerprint string, distinct_shingles double")


def beside_next(docs: DataFrame) -> DataFrame:
    """``bucket, border, id, text``: documents in buckets of neighbouring ids, each bucket followed by the
    first documents after it as ``border`` rows (after the last bucket: the first documents of all).

    Bounds of buckets are quantiles of the ids, so buckets are alike in rows; texts are shuffled once.
    """
    rows = bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("text").cast("string").alias("text"))
    n, first = rows.agg(F.count(F.lit(1)), F.min("id")).first()
    count = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    cuts = [i / count for i in range(1, count)]
    bounds = rows.agg(F.percentile_approx("id", cuts, max(10_000, 10 * count))).first()[0] if cuts else []
    starts = np.array(sorted({x for x in bounds if x > first}), np.int64)  # ids that exist
    last = len(starts)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Twice the bucket, and one more for a border row."""
        at = ids.to_numpy(np.int64)
        own, starting = np.searchsorted(starts, at, side="right"), np.isin(at, starts)
        made = [[2 * o] + [2 * o - 1] * s + [2 * last + 1] * (x == first) for o, s, x in zip(own.tolist(), starting.tolist(), at.tolist())]
        return pd.Series(made, dtype=object)

    dealt = rows.withColumn("place", F.explode(places("id"))).select((F.col("place") / 2).cast("int").alias("bucket"), (F.col("place") % 2).alias("border"), "id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "border", "id", "text")


def compare_with_edited(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Documents
    follow by id, null ids first, rows that repeat an id by text; after the last comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the row whose next one hasn't come: id, bucket, border, text, sketch
        for part in text_slices(batches):
            texts = [x.as_py() or "" for x in part.column("text")]
            made = sketches(part.column("text"), k, words)
            rows = held + list(zip(part.column("id").to_pylist(), part.column("bucket").to_pylist(), part.column("border").to_pylist(), texts, made))
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == b[1] and not a[2]]
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            again = sketches(pa.array(edited, pa.string()), k, words)
            out = [
                (a[0] if a[0] > -(2**63) else None, len(a[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), written(a[4]), written(s), resemblance(a[4], s, k), resemblance(a[4], b[4], k))
                for (a, b), e, s in zip(pairs, edited, again)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)
            held = rows[-1:]

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLE_SQL: dict[str, str] = {}
