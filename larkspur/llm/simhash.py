"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits over word shingles; two documents are linked if their fingerprints differ in
at most ``THRESHOLD`` = 3 bits, so in one of the two halves they differ in at most one bit. The first
31 bits of a half are covered by the perfect Hamming code of length 31: every point has exactly one
anchor (code word) within distance 1, its home, and at most 15 more at distance 2. A fingerprint is
replicated to each anchor within covering radius plus the half's threshold (1 + 1), so of two linked
fingerprints the home of one is among the anchors of the other, in one half at least. Per anchor
those at home are compared with all. What comes out is a spanning forest of the links in each anchor,
never all pairs; components follow by contraction.

Equal fingerprints are one point. Anchors with more than ``CELL`` fingerprints are cut into chunks,
each pair of chunks a task's group of its own, so no group is larger than ``2 * CELL``.

Edge cases: null and empty texts have fingerprint zero, linked like any other; null ids take part, but
a component is named by the smallest id that isn't null (null if there is none); rows that repeat an
id or are equal keep their own result rows; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, text_slices
from larkspur.llm.components import connected_components
from larkspur.sources.storage import stored, table

THRESHOLD = 3
WORDS = 3
SEED = 42
#: Fingerprints of an anchor that are compared in one group.
CELL = 2048
#: Anchors with over CELL fingerprints up to this number (16 bytes each) are broadcast.
BROADCAST_ANCHORS = 20_000
#: Parts that the rows of one fingerprint are dealt into where they get their component.
SALTS = 63
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words in runs of about PIECE bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        stop = cut.end() if cut else len(data)
        yield data[at:stop].split()
        at = stop


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint: bits set in over half of the hashes of ``words``-word shingles."""
    counts, total, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for run in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        held += run
        n = len(held) - words + 1
        if n <= 0:
            continue
        joined = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held])
        starts, stops = (ends - [len(w) + 1 for w in held])[:n].tolist(), (ends[words - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
        counts += bit_counts(hashes)
        total += n
        held = held[n:]
    if not total:
        if not held:
            return 0
        counts, total = bit_counts(np.array([digest(b" ".join(held), seed)], np.uint64)), 1
    return int((np.uint64(1) << np.flatnonzero(2 * counts > total).astype(np.uint64)).sum(dtype=np.uint64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return counts


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            made = np.array([simhash(x.as_py(), words) for x in part.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])

    ids = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``index, anchor, home``: the anchors of each unsigned fingerprint, both halves."""
    out = []
    places = np.arange(1, 32, dtype=np.uint64)
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        bits = (x[:, None] >> (places - np.uint64(1))) & np.uint64(1)
        syndrome = np.bitwise_xor.reduce(bits * places, axis=1)
        flip = lambda p: np.where(p > 0, np.uint64(1) << (np.maximum(p, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        tag, index = np.uint64(half) << np.uint64(31), np.arange(len(fps))
        out.append((index, (x ^ flip(syndrome)) | tag, np.ones(len(fps), bool)))
        for p in places:
            q = syndrome ^ p
            use = (syndrome > 0) & (q > p)
            out.append((index[use], (x ^ flip(np.full_like(x, p)) ^ flip(q))[use] | tag, np.zeros(int(use.sum()), bool)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        index, anchor, home = anchors(fps)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between ``home`` fingerprints and all."""
    label = np.arange(len(fps))
    for i in np.flatnonzero(home):
        near = label[np.bitwise_count(fps ^ fps[i]) <= threshold]
        roots = np.unique(near)
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[far], fps[label[far]]


def _close_pairs(group: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within small groups, all groups at once; rows are sorted by group."""
    u, v, shift = [], [], 1
    while True:
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        use = same & (home[shift:] | home[:-shift]) & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= threshold)
        at = np.flatnonzero(use)
        u.append(fps[at + shift])
        v.append(fps[at])
        shift += 1
    return (np.concatenate(u), np.concatenate(v)) if u else (fps[:0], fps[:0])


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group seen, which may go on

        def links(anchor, cell, fps, home):
            starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])
            sizes = np.diff(np.r_[starts, len(anchor)])
            group = np.repeat(np.arange(len(starts)), sizes)
            few = np.repeat((sizes > 1) & (sizes <= 32), sizes)
            found = [_close_pairs(group[few], fps[few], home[few], threshold)] if few.any() else []
            found += [forest(fps[a : a + n], home[a : a + n], threshold) for a, n in zip(starts, sizes) if n > 32]
            for u, v in found:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "fp", "home")]
            now[2] = now[2].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            yield from links(*(x[:cut] for x in now)) if cut else ()
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield from links(*held)

    return run


def links(points: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``u, v``: links that connect what all links at ``threshold`` <= 3 connect, of distinct ``fp``."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"anchors cover thresholds up to {THRESHOLD}")
    replicas = points.select("fp").mapInArrow(_replicated, "anchor long, fp long, home boolean")
    hot = stored(replicas.groupBy("anchor").count().filter(F.col("count") > CELL), "hot")
    n = hot.count()
    if n:
        replicas = replicas.join(F.broadcast(hot) if n <= BROADCAST_ANCHORS else hot, "anchor", "left")
        chunks = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(CELL)).cast("long")
        replicas = replicas.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least("own", j) * F.col("chunks") + F.greatest("own", j))
        replicas = replicas.withColumn("cell", F.explode(cell))
    else:
        replicas = replicas.withColumn("cell", F.lit(0).cast("long"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = replicas.select("anchor", "cell", "fp", "home").repartition(parts, "anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(_linked(threshold), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    marked = stored(fingerprints(docs, words).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "simhash")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt").cast("int"))
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.bit_or(bit).alias("salts")), "points")
    names = connected_components(stored(links(points, threshold), "links"))
    grouped = points.join(names, points["fp"] == names["node"]).select("fp", "root", "first_id")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("least_id"))
    joined = grouped.join(least, "root").select("fp", "least_id")
    points = points.join(joined, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), "salts")
    own = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    points = points.select("fp", "component_id", F.explode(F.transform(own, lambda i: i.cast("long"))).alias("salt"))
    return marked.join(points, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def row_key() -> list[Column]:
    """Whether the id is null, the id, and a hash of the text: equal for rows of one id and text only."""
    own = F.col("doc_id").cast("long")
    return [own.isNull().alias("no_id"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("of_text")]


def one_of_each(docs: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``points`` (``fp, first``: the least row key of a point) under ``links``.

    It is the row with the least key: that of the smallest id, null ids last, then of the least hash of the text.
    """
    names = stored(connected_components(stored(links, "links")), "names")
    linked = points.join(names, points["fp"] == names["node"]).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    single = points.join(names, points["fp"] == names["node"], "left_anti").select("first.*")
    kept = linked.unionByName(single)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *row_key())
    return rows.join(kept, ["no_id", "id", "of_text"]).dropDuplicates(["no_id", "id", "of_text"]).select("doc.*")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The row of one document of each component, that of the smallest id, in all its columns.

    Components are of texts, not of ids: unlinked texts all keep a row, whether their ids repeat or are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            made = np.array([simhash(x.as_py(), words) for x in part.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("no_id", "id", "of_text")), pa.array(made)], names=["no_id", "id", "of_text", "fp"])

    marked = bounded(docs).select(*row_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, "no_id boolean, id long, of_text long, fp long")
    points = stored(marked.groupBy("fp").agg(F.min(F.struct("no_id", "id", "of_text")).alias("first")), "points")
    return one_of_each(docs, points, links(points, threshold))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
