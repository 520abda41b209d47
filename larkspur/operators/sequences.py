"""Making and changing nucleotide sequences, one row a sequence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hashing import counted, shuffle_key, uniform
from larkspur.functions.sequence import is_clean, on_strand, overwrite
from larkspur.operators.relational import numbered

#: Fixed value: letters in the order of a matrix's columns.
BASES = np.frombuffer(b"ACGT", np.uint8)
#: Letters that are drawn at once.
LETTERS = 1 << 20
#: Sequences that are shuffled at once, letters they may have together, and walks that are left to go on one by one.
SHUFFLED, FEW, ALONE = 4_096, 5, 8


def region_sequences(regions: DataFrame, genome: DataFrame, window_bin: int = 1 << 16) -> DataFrame:
    """Regions with ``seq`` from ``genome(chrom, chunk_start, seq)``, read on their strand and upper-cased.

    Chunks meet regions by an equi-join on bins of positions and are put together in order; regions that
    are not wholly covered are left out.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / window_bin), F.floor((b - 1) / window_bin)))
    chunks = genome.withColumn("chunk_stop", F.col("chunk_start") + F.length("seq")).withColumn("bin", spread(F.col("chunk_start"), F.col("chunk_stop")))
    wanted = regions.filter("start >= 0 AND start < stop").withColumn("bin", spread(F.col("start"), F.col("stop")))
    met = wanted.join(chunks.select("chrom", "bin", "chunk_start", "chunk_stop", F.col("seq").alias("chunk")), ["chrom", "bin"]).filter("chunk_start < stop AND chunk_stop > start")
    low, high = F.greatest("start", "chunk_start"), F.least("stop", "chunk_stop")
    part = F.struct(low.alias("at"), F.substring(F.col("chunk"), low - F.col("chunk_start") + 1, high - low).alias("text"))
    joined = met.withColumn("part", part).groupBy(*regions.columns).agg(F.array_sort(F.collect_set("part")).alias("parts"))
    seq = F.upper(F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    whole = joined.withColumn("seq", seq).filter(F.length("seq") == F.col("stop") - F.col("start"))
    return whole.withColumn("seq", on_strand(F.col("seq"), F.col("strand")) if "strand" in regions.columns else F.col("seq")).drop("parts")


def drop_unclean(rows: DataFrame) -> DataFrame:
    return rows.filter(is_clean(F.col("seq")))


def synthetic_gc(rows: DataFrame, gc: float, seed: str) -> DataFrame:
    """``gc, seq_id, seq`` for each of ``seq_id, length``: independent bases, G and C together with probability ``gc``."""
    name = f"{gc:.2f}"
    draw = lambda i: uniform(seed, name, F.col("seq_id"), i)
    letter = lambda u: F.when(u < (1 - gc) / 2, "A").when(u < 0.5, "C").when(u < 0.5 + gc / 2, "G").otherwise("T")
    bases = F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), lambda i: letter(draw(i)))
    return rows.filter("length > 0").select(F.lit(name).alias("gc"), "seq_id", F.array_join(bases, "").alias("seq"))


def with_synthetic_gc(rows: DataFrame, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """``concept, seq_id, seq`` for each of ``seq_id, length`` and each concept with its share of G and C: the same bases by arrays, drawn from the row's key, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, at = np.cumsum(batch.column("length").to_numpy()), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LETTERS, "right")))
                ids, sizes = batch.column("seq_id").slice(at, end - at), batch.column("length").to_numpy()[at:end]
                starts, keys = np.cumsum(sizes) - sizes, np.repeat(pc.fill_null(ids, 0).to_numpy(), sizes)
                place = np.arange(len(keys)) - np.repeat(starts, sizes)
                for concept, gc in shares.items():
                    u = counted(seed, keys, 3, round(gc * 1e4), place)
                    drawn = sum((u >= edge).astype(np.uint8) for edge in ((1 - gc) / 2, 0.5, 0.5 + gc / 2))
                    yield pa.RecordBatch.from_arrays([pa.array([concept] * len(ids), pa.string()), ids, Letters(BASES[drawn], starts, sizes).strings()], names=["concept", "seq_id", "seq"])
                at = end

    narrow = rows.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("length").cast("long").alias("length"))
    return narrow.filter("length > 0").mapInArrow(run, "concept string, seq_id long, seq string")


def gc_grid(step: float) -> list[float]:
    """0, step, ... up to 1."""
    if not 0 < step <= 1:
        raise ValueError("step must be over 0 and at most 1")
    return [min(1.0, i * step) for i in range(int(1 / step + 1e-9) + 1)]


def saturated(seq: Column, motif: Column, start: Column | int, gap: int) -> Column:
    """The motif written over a sequence again and again, ``gap`` bases apart, as often as it fits."""
    start = F.lit(start) if isinstance(start, int) else start
    stride = F.length(motif) + gap
    last = F.length(seq) - F.length(motif)
    places = F.when(start <= last, F.sequence(start, last, stride)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, seq, lambda done, at: overwrite(done, motif, at))


def paired(seq: Column, first: Column, second: Column, at: Column, spacing: int) -> Column:
    """Two motifs with ``spacing`` bases of the sequence between them."""
    return overwrite(overwrite(seq, first, at), second, at + F.length(first) + spacing)


def with_region_insert(rows: DataFrame, inserts: DataFrame, at: Column, seed: str) -> DataFrame:
    """Each sequence overwritten with one of ``inserts(insert_id, insert)``, picked by hash.

    The inserts are numbered and met by an equi-join on the number.
    """
    n = inserts.count()
    places = numbered(inserts, "insert_id").withColumnRenamed("ordinal", "pick")
    picked = rows.withColumn("pick", F.floor(uniform(seed, "insert", F.col("seq_id")) * n).cast("long"))
    return picked.join(places, "pick").withColumn("seq", overwrite(F.col("seq"), F.col("insert"), at)).drop("pick", "insert")


def mixed(rows: DataFrame, variants: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` of all pairs of a row and a motif variant, in hash order; ``variants`` is a small table."""
    pairs = rows.crossJoin(F.broadcast(variants))
    return pairs.orderBy(shuffle_key(seed, F.col("seq_id"), F.col("variant"))).limit(n)


def seeded(seed: int, *key) -> np.random.Generator:
    """A generator that depends on the row's own key only."""
    return np.random.default_rng([seed, *(int.from_bytes(str(k).encode(), "big") % (1 << 63) for k in key)])


class Letters(NamedTuple):
    """Sequences of a batch one after another: all letters, and where each sequence begins and how long it is."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, seqs: pa.Array) -> "Letters":
        raw = pc.cast(pc.fill_null(seqs, ""), pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        return cls(data, ends[:-1] - ends[0], np.diff(ends))

    def strings(self) -> pa.Array:
        ends = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        return pc.cast(pa.Array.from_buffers(pa.large_string(), len(self.sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.flat))]), pa.string())


def inserted(letters: Letters, keys: np.ndarray, variants: Sequence[np.ndarray], count: int, start_buffer: int = 0, end_buffer: int = 0, seed: int = 1) -> tuple[Letters, np.ndarray]:
    """All sequences of a batch with up to ``count`` drawn motifs at free places between the buffers, never over one another; and the places (-1: none).

    A sequence's free places are a few stretches: each step picks one place of all, evenly, and cuts its stretch in two. ``variants`` are cumulative
    probabilities, places by letters; a sequence gets one of them. What is drawn depends on the row's key only.
    """
    n, rows = len(keys), np.arange(len(keys))
    which = np.minimum((counted(seed, keys, 0) * len(variants)).astype(np.int64), len(variants) - 1)
    width = np.array([len(v) for v in variants], np.int64)[which]
    low, high = np.full((n, count + 1), 0, np.int64), np.full((n, count + 1), 0, np.int64)
    low[:, 0], high[:, 0] = start_buffer, letters.sizes - width - end_buffer
    flat, places = letters.flat.copy(), np.full((n, count), -1, np.int64)
    for t in range(count):
        room = np.maximum(high - low, 0)
        upto = np.cumsum(room, axis=1)
        open_ = upto[:, -1] > 0
        pick = np.minimum((counted(seed, keys, 1, t) * upto[:, -1]).astype(np.int64), np.maximum(upto[:, -1] - 1, 0))
        j = np.minimum((upto <= pick[:, None]).sum(axis=1), count)
        at = low[rows, j] + pick - (upto[rows, j] - room[rows, j])
        low[rows, t + 1] = np.where(open_, at + width, 0)
        high[rows, t + 1] = np.where(open_, high[rows, j], 0)
        high[rows, j] = np.where(open_, np.minimum(high[rows, j], at - width + 1), high[rows, j])
        places[open_, t] = at[open_]
        for v, cumulative in enumerate(variants):
            own = np.flatnonzero(open_ & (which == v))
            u = counted(seed, keys[own][:, None], 2, t, np.arange(len(cumulative))[None, :])
            drawn = sum((u >= cumulative[None, :, k]).astype(np.uint8) for k in range(3))
            flat[(letters.starts[own] + at[own])[:, None] + np.arange(len(cumulative))] = BASES[drawn]
    return letters._replace(flat=flat), places


class Insertion(NamedTuple):
    """A concept of sequences with one of several motif variants put in."""

    concept: str
    role: str
    variants: list[np.ndarray]


def with_insertions(rows: DataFrame, concepts: Sequence[Insertion], count: int, start_buffer: int = 0, end_buffer: int = 0, seed: int = 1) -> DataFrame:
    """``concept, role, seq_id, seq``: every sequence once for each concept, in one pass over ``seq_id, seq`` whatever the number of concepts."""
    every = [(c.concept, c.role, [np.cumsum(np.asarray(v, float), axis=1) for v in c.variants]) for c in concepts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, ids = Letters.of(batch.column("seq")), batch.column("seq_id")
            for concept, role, variants in every:
                made, _ = inserted(letters, ids.to_numpy(), variants, count, start_buffer, end_buffer, seed)
                names = [pa.array([x] * batch.num_rows, pa.string()) for x in (concept, role)]
                yield pa.RecordBatch.from_arrays([*names, ids, made.strings()], names=["concept", "role", "seq_id", "seq"])

    return rows.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").filter("seq_id IS NOT NULL").mapInArrow(run, "concept string, role string, seq_id long, seq string")


def with_motifs(rows: DataFrame, probabilities: np.ndarray | Sequence[np.ndarray], count: int, start_buffer: int = 0, end_buffer: int = 0, seed: int = 1) -> DataFrame:
    """``seq_id, seq, places``: motif instances drawn from a position probability matrix into every sequence.

    Of several matrices, the variants of a motif, each sequence gets one by its hash.
    """
    one = isinstance(probabilities, np.ndarray) or np.ndim(probabilities[0][0]) == 0
    variants = [np.cumsum(np.asarray(m, float), axis=1) for m in ([probabilities] if one else probabilities)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, places = inserted(Letters.of(batch.column("seq")), batch.column("seq_id").to_numpy(), variants, count, start_buffer, end_buffer, seed)
            there = places >= 0
            ends = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), made.strings(), pa.ListArray.from_arrays(ends, pa.array(places[there].astype(np.int32)))], names=["seq_id", "seq", "places"])

    return rows.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").filter("seq_id IS NOT NULL").mapInArrow(run, "seq_id long, seq string, places array<int>")


def kmer_shares(rows: DataFrame, k: int = 3) -> DataFrame:
    """``vector`` instead of ``seq``: the shares of all ``4**k`` strings of A, C, G, T among a sequence's; zeros if it has none. Other columns stay."""
    code = np.full(256, -1, np.int64)
    code[list(b"ACGT")] = range(4)
    kept = [c for c in rows.columns if c != "seq"]
    schema = rows.select(*kept, F.array().cast("array<double>").alias("vector")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters.of(batch.column("seq"))
            flat, n = code[letters.flat], max(0, len(letters.flat) - k + 1)
            parts = [flat[i : i + n] for i in range(k)]
            row = np.repeat(np.arange(batch.num_rows), letters.sizes)
            clean = np.all([p >= 0 for p in parts], axis=0) & (row[:n] == row[k - 1 :][:n]) if n else np.zeros(0, bool)
            number = sum(p[clean] * 4 ** (k - 1 - i) for i, p in enumerate(parts)) if n else np.zeros(0, np.int64)
            counts = np.bincount(row[:n][clean] * 4**k + number, minlength=batch.num_rows * 4**k).reshape(batch.num_rows, 4**k)
            shares = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).ravel()
            ends = pa.array((np.arange(batch.num_rows + 1) * 4**k).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(shares))], names=[*kept, "vector"])

    return rows.select(*kept, "seq").mapInArrow(run, schema)


def kmer_and_track_shares(rows: DataFrame, k: int = 3, parts: int = 4) -> DataFrame:
    """``vector`` instead of ``seq`` and ``track``: shares of strings, then the means of ``parts`` stretches of the track, 0 without one."""
    size = F.ceil(F.size("track") / parts)
    means = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.aggregate(F.slice("track", (i * size + 1).cast("int"), size.cast("int")), F.lit(0.0), lambda a, x: a + x) / F.greatest(size, F.lit(1)))
    none = F.array_repeat(F.lit(0.0), parts)
    found = kmer_shares(rows, k)
    return found.withColumn("vector", F.concat("vector", F.when(F.size("track") > 0, means).otherwise(none))).drop("track")


def last_edges(counts: np.ndarray, end: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each sequence and letter, the letter its last edge leads to: a random tree towards ``end``, likely by the number of edges.

    ``counts`` has the edges between letters (sequences by letters by letters). All choices of a last edge per letter are weighed at once, those with
    a circle by 0; letters are few, so these are few. -1 for ``end`` and for letters that don't occur.
    """
    n, k, _ = counts.shape
    chosen = np.full((n, k), -1)
    occurs = counts.sum(axis=2) > 0
    for e in range(k):
        own = np.flatnonzero(end == e)
        if not len(own):
            continue
        others = [x for x in range(k) if x != e]
        choices = np.array(list(product(range(k), repeat=len(others)))).reshape(-1, len(others))
        to = np.full((len(choices), k), e)
        to[:, others] = choices
        at = to.copy()
        for _ in range(k):
            at = np.take_along_axis(to, at, axis=1)
        # Letters that don't occur lead to the end by one choice only, and so weigh nothing.
        weight = np.ones((len(own), len(choices)))
        for i, x in enumerate(others):
            edges = counts[own, x].astype(float)
            edges = np.where(occurs[own, x, None], edges, np.eye(k)[e])
            weight *= edges[:, choices[:, i]] / edges.sum(axis=1, keepdims=True)
        weight[:, ~(at == e).all(axis=1)] = 0
        upto = np.cumsum(weight, axis=1)
        pick = np.minimum((upto <= (u[own] * upto[:, -1])[:, None]).sum(axis=1), len(choices) - 1)
        chosen[own] = np.where(occurs[own], to[pick], -1)
        chosen[own, e] = -1
    return chosen


def shuffled(letters: Letters, keys: np.ndarray, seed: int, copy: int, alphabet: np.ndarray) -> Letters:
    """Random sequences with the same pairs of neighbours each, all sequences of a batch at once.

    Neighbours are edges between letters. The last edge out of each letter comes from a random tree towards the last letter, the other
    edges in any order; edges are sorted by random keys, and all walks take a step together, the longest last.
    """
    n, k, total = len(letters.sizes), len(alphabet), len(letters.flat)
    code = np.searchsorted(alphabet, letters.flat).astype(np.int64)
    row = np.repeat(np.arange(n), letters.sizes)
    place = np.arange(total) - letters.starts[row]
    edge = np.flatnonzero(place[1:] > 0) if total else np.zeros(0, np.int64)  # edges begin at these letters
    of, out, into = row[edge], code[edge], code[edge + 1]
    counts = np.bincount((of * k + out) * k + into, minlength=n * k * k).reshape(n, k, k)
    some = letters.sizes > 0
    end = np.full(n, -1)
    end[some] = code[(letters.starts + letters.sizes - 1)[some]]
    final = last_edges(counts, end, counted(seed, keys, 3, copy))
    order_key = counted(seed, keys[of], 4, copy, place[edge])
    first = np.full(n * k * k, -1)
    kind = (of * k + out) * k + into
    first[kind[::-1]] = np.arange(len(edge))[::-1]  # one edge of each kind
    wanted = np.flatnonzero(final.ravel() >= 0)
    order_key[first[wanted * k + final.ravel()[wanted]]] = 2.0
    sort = np.lexsort((order_key, of * k + out))
    into = into[sort]
    begin = np.searchsorted((of * k + out)[sort], np.arange(n * k))
    longest = np.argsort(-letters.sizes, kind="stable")
    sizes, at = letters.sizes[longest], np.zeros(n, np.int64)
    made = letters.flat.copy()
    at[:] = np.where(sizes > 0, code[np.minimum(letters.starts[longest], max(0, total - 1))] if total else 0, 0)
    used, live = begin.reshape(n, k)[longest], n
    lines, starts = np.arange(n), letters.starts[longest]
    for t in range(1, int(sizes[0]) if n else 0):
        while live and sizes[live - 1] <= t:
            live -= 1
        if live <= ALONE:
            _walked(made, alphabet, into, used, at, starts, sizes, live, t)
            break
        now = lines[:live]
        edge_at = used[now, at[:live]]
        used[now, at[:live]] += 1
        at[:live] = into[edge_at]
        made[starts[:live] + t] = alphabet[at[:live]]
    return letters._replace(flat=made)


def _walked(made: np.ndarray, alphabet: np.ndarray, into: np.ndarray, used: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, live: int, t: int) -> None:
    """The rest of the few longest walks, one by one."""
    for i in range(live):
        own, here = used[i].tolist(), int(at[i])
        base = min(own)
        follow, path = into[base : base + int(sizes[i]) + 1].tolist(), []
        for _ in range(t, int(sizes[i])):
            step = own[here]
            own[here] = step + 1
            here = follow[step - base]
            path.append(here)
        made[int(starts[i]) + t : int(starts[i]) + int(sizes[i])] = alphabet[path]


def with_shuffles(rows: DataFrame, copies: int = 10, seed: int = 1) -> DataFrame:
    """``seq_id, copy, seq``: dinucleotide-preserving shuffles; what is drawn depends on the row's key and the copy only.

    Sequences of up to ``FEW`` different letters in a batch are shuffled together, others by ``dinucleotide_shuffled``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SHUFFLED) for i in range(0, batch.num_rows, SHUFFLED)):
                letters, ids = Letters.of(part.column("seq")), part.column("seq_id")
                alphabet = np.unique(letters.flat)
                for copy in range(copies):
                    if len(alphabet) <= FEW:
                        made = shuffled(letters, ids.to_numpy(), seed, copy, alphabet).strings()
                    else:
                        made = pa.array([dinucleotide_shuffled(s or "", seeded(seed, i, copy)) for i, s in zip(ids.to_pylist(), part.column("seq").to_pylist())], pa.string())
                    yield pa.RecordBatch.from_arrays([ids, pa.array([copy] * part.num_rows, pa.int32()), made], names=["seq_id", "copy", "seq"])

    return rows.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").filter("seq_id IS NOT NULL").mapInArrow(run, "seq_id long, copy int, seq string")


def dinucleotide_shuffled(seq: str, rng: np.random.Generator) -> str:
    """A random sequence with the same pairs of neighbours, hence the same ends.

    Neighbours are edges between letters; a random spanning tree towards the last letter keeps the
    last edge out of each letter, the other edges come in any order, and a walk spends them all.
    """
    if len(seq) < 3:
        return seq
    letters, code = np.unique(list(seq), return_inverse=True)
    n, end = len(letters), int(code[-1])
    after = [list(code[1:][code[:-1] == i]) for i in range(n)]
    final = [-1] * n
    reached = {end}
    for start in range(n):  # loop-erased random walks to what is reached already
        at = start
        while at not in reached:
            final[at] = int(rng.integers(len(after[at])))
            at = int(after[at][final[at]])
        at = start
        while at not in reached:
            reached.add(at)
            at = int(after[at][final[at]])
    for i in range(n):
        last = [after[i].pop(final[i])] if i != end else []
        rng.shuffle(after[i])
        after[i] = (after[i] + last)[::-1]
    out, at = [int(code[0])], int(code[0])
    while after[at]:
        at = int(after[at].pop())
        out.append(at)
    return "".join(letters[out])
