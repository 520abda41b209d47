"""Hierarchical packing of token sequences into windows of several lengths.

Documents are encoded, and closed by ``END_ID``, in the partition where they are read; packing moves
nothing between partitions. Within a partition:

1. Routing: a document gives whole windows of the largest tier; its rest belongs to the smallest tier that
   holds it.
2. Packing: from the largest tier down, each rest opens a window of its tier, and the gap is filled with the
   largest rests of shorter tiers that fit whole; where none fits, the shortest is cut. This goes on
   while the rests suffice for a window, in units of ``UNIT_DOCS`` rests or ``UNIT_TOKENS`` tokens; what is
   left joins the next unit.
3. The partition's last rests, less than a window together, go to windows of falling tiers. Only the last
   of these isn't full; it is padded to the largest tier.
4. Balancing: windows of one tier are dealt into step groups of ``STEP_TOKENS`` tokens, so a step's
   windows are equally long and all full steps have as many tokens. They are numbered over ``BUNDLE``
   partitions at a time, so at most one group of each tier and bundle isn't full.

Edge cases: null texts are empty and give the end token alone; repeated rows, and null ids, are packed
each for itself; other columns are ignored; an empty table gives an empty one; a text of any length is
cut into windows one after another. The rows of a partition give the same result whenever it is run again.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from larkspur.llm.batches import bounded, text_slices
from larkspur.sources.storage import stored, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Window lengths, powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP_TOKENS = 1 << 16
UNIT_DOCS, UNIT_TOKENS = 4_096, 4 << 20
#: Bytes of words and their ids that a Python worker keeps.
CACHE_BYTES = 64 << 20
#: Bytes of text that are encoded at once, but for a single longer text.
SLICE_BYTES = 4 << 20
#: Sequence numbers: the partition's number, then this many bits; step numbers likewise with the bundle's.
LOCAL_BITS = 36
#: Partitions whose windows are numbered together, from the counts of each.
BUNDLE = 64


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer.from_file(path)


#: Letters that normalisation leaves as they are, whatever follows: Latin ones that are never part of another.
PLAIN = "a-zß-öø-ÿ"
# The settings of tokenizers that drop white space and encode each word by itself.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Ids of words, kept from one call to the next while they take at most ``CACHE_BYTES``."""

    def __init__(self, path: str):
        self.whole = tokenizer(path)
        self.by_words = all(json.loads(self.whole.to_str())[k] == v for k, v in BY_WORDS.items())
        own = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = str.maketrans({c: own.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])})
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def encoded(self, words: pa.Array) -> pa.Array:
        """Ids of each word; a word of plain letters is one word to the tokenizer and needs its merges only."""
        plain = pc.match_substring_regex(words, f"^[{PLAIN}]+$").to_numpy(zero_copy_only=False)
        texts, merges, found = words.to_pylist(), self.whole.model.tokenize, [None] * len(words)
        for i in np.flatnonzero(plain).tolist():
            found[i] = [t.id for t in merges(texts[i] if texts[i].isascii() else texts[i].translate(self.bytes_of))]
        rest = np.flatnonzero(~plain).tolist()
        for some in (rest[i : i + 4096] for i in range(0, len(rest), 4096)):  # encodings are large while they live
            for i, e in zip(some, self.whole.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)):
                found[i] = e.ids
        return pa.array(found, pa.list_(pa.uint32()))

    def of(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        at = pc.index_in(words, self.words)
        new = words.filter(pc.is_null(at))
        ids = pa.concat_arrays([self.ids, self.encoded(new)])
        at = at.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), len(self.words) + np.cumsum(np.isnan(at)) - 1, at).astype(np.int64)
        if self.words.nbytes + new.nbytes + ids.nbytes > CACHE_BYTES:
            self.forget()
        else:
            self.words, self.ids = pa.concat_arrays([self.words, new]), ids
        return ids.take(pa.array(at))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    return WordIds(path)


def encoded(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of every text with END_ID.

    A tokenizer with the settings ``BY_WORDS`` drops white space and never joins what it separates, so the
    ids of a text are those of its parts between ASCII white space; each distinct part is encoded once.
    It also lower-cases, and takes ASCII punctuation between a letter and white space by itself, so
    doing that first changes no id but leaves fewer distinct parts: for ``PLAIN`` letters, as others may
    end in a mark once normalised, which goes with the punctuation. Only its special tokens, which begin
    with ``<|``, mind capitals. Texts of any other tokenizer are encoded as they are.
    """
    whole, known = pc.fill_null(texts.cast(pa.string()), ""), word_ids(path)
    if not known.by_words:
        made = known.whole.encode_batch_fast(whole.to_pylist(), add_special_tokens=False)
        return [np.array([*e.ids, END_ID], np.uint32) for e in made]
    if not pc.any(pc.match_substring(whole, "<|")).as_py():
        whole = pc.replace_substring_regex(pc.ascii_lower(whole), rf"([{PLAIN}])([!-/:-@\[-`{{-~]+)([ \n])", r"\1 \2\3")
    split = pc.ascii_split_whitespace(whole)
    words = split.flatten()
    coded = words.dictionary_encode()
    ids = pa.concat_arrays([known.of(coded.dictionary), pa.array([[END_ID]], pa.list_(pa.uint32()))])
    offsets = split.offsets.to_numpy()
    code = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:] - offsets[0], len(ids) - 1)
    size = np.diff(ids.offsets.to_numpy())
    ends = np.cumsum(size[code])[offsets[1:] - offsets[0] + np.arange(len(texts))]
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = 0
    for some in range(0, len(code), 1 << 17):  # parts at a time, for memory
        part = ids.take(pa.array(code[some : some + (1 << 17)])).flatten().to_numpy()
        flat[at : at + len(part)] = part
        at += len(part)
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


Piece = tuple[int, int, int]  # document, start, length
Window = tuple[int, list[Piece]]  # tier, pieces


def pack_rests(rests: list[Piece], tiers: Sequence[int] = TIERS) -> tuple[list[Window], list[Piece]]:
    """Full windows of rests no longer than the largest tier, and the rests left over.

    What is left is less than a window of the tier that the longest of them belongs to.
    """
    windows: list[Window] = []
    held = sorted((n, d, at) for d, at, n in rests)
    total = sum(n for n, _, _ in held)
    for i in reversed(range(len(tiers))):
        tier, floor = tiers[i], tiers[i - 1] if i else 0
        while held and held[-1][0] > floor and total >= tier:
            n, d, at = held.pop()
            pieces, gap = [(d, at, n)], tier - n
            while gap:
                fits = bisect_right(held, (gap, 1 << 62, 0))
                n, d, at = held.pop(fits - 1 if fits else 0)
                use = min(n, gap)
                pieces.append((d, at, use))
                gap -= use
                if n > use:  # none fits whole: the shortest is cut
                    insort(held, (n - use, d, at + use))
            windows.append((tier, pieces))
            total -= tier
        if held and held[-1][0] > floor:
            break
    return windows, [(d, at, n) for n, d, at in sorted(held, key=lambda x: x[1:])]


def close(rests: list[Piece], tiers: Sequence[int] = TIERS) -> list[Window]:
    """Windows of falling tiers for rests of less than a window; the last one may not be full."""
    windows: list[Window] = []
    todo, total = list(reversed(rests)), sum(n for _, _, n in rests)
    while total:
        tier = next((t for t in reversed(tiers) if t <= total), None)
        room, pieces = min(total, tier or total), []
        total -= room
        while room:
            d, at, n = todo.pop()
            use = min(n, room)
            pieces.append((d, at, use))
            room -= use
            if use < n:
                todo.append((d, at + use, n - use))
        windows.append((tier or tiers[-1], pieces))
    return windows


def _packed(vocabulary: str, tiers: Sequence[int]):
    """Pieces of a partition; ``turn`` numbers its windows of each tier."""
    names, top = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "turn"], tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << LOCAL_BITS
        turns = dict.fromkeys(tiers, 0)
        ids: dict[int, tuple] = {}  # documents that still have rests
        rests: list[Piece] = []
        seen = tokens = 0

        def written(windows: list[Window]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for tier, pieces in windows:
                at = 0
                for d, start, length in pieces:
                    doc_id, own, first_id, n_ids = ids[d]
                    piece = own[start - first_id : start - first_id + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece.astype("<u4", copy=False)), n_ids, sequence, at, tier, turns[tier]))
                    at += length
                sequence += 1
                turns[tier] += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in names], names=names)

        for part in text_slices(batches, limit=SLICE_BYTES):
            whole: list[Window] = []
            for doc_id, own in zip(part.column("doc_id").to_pylist(), encoded(part.column("text"), vocabulary)):
                ids[seen] = (doc_id, own, 0, len(own))
                full = len(own) // top * top
                whole += [(top, [(seen, at, top)]) for at in range(0, full, top)]
                if full < len(own):
                    rests.append((seen, full, len(own) - full))
                    tokens += len(own) - full
                seen += 1
            yield written(whole)
            for d, at, n in rests:  # of a document, only the rest is kept
                doc_id, own, first_id, n_ids = ids[d]
                if own.base is not None:
                    ids[d] = (doc_id, own[at - first_id :].copy(), at, n_ids)
            if tokens >= UNIT_TOKENS or len(rests) >= UNIT_DOCS:
                windows, rests = pack_rests(rests, tiers)
                yield written(windows)
                tokens = sum(n for _, _, n in rests)
            waiting = {d for d, _, _ in rests}
            ids = {d: x for d, x in ids.items() if d in waiting}
        windows, rests = pack_rests(rests, tiers)
        yield written(windows)
        yield written(close(rests, tiers))

    return run, ", ".join(f"`{n}` long" for n in names)


def with_steps(pieces: DataFrame, tiers: Sequence[int]) -> DataFrame:
    """``turn`` turned into ``step_group``: windows of a tier in the order of the bundle's partitions."""
    part = F.shiftright("sequence_id", LOCAL_BITS).alias("part")
    held = pieces.filter("offset = 0").groupBy(part, F.col("window").alias("tier")).count()
    earlier = F.sum("count").over(W.partitionBy(F.floor(F.col("part") / BUNDLE), "tier").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = held.select("part", "tier", F.coalesce(earlier, F.lit(0)).alias("before"))
    per_step = F.coalesce(*(F.when(F.col("window") == t, max(1, STEP_TOKENS // t)) for t in tiers))
    number = F.floor((F.col("turn") + F.col("before")) / per_step)
    step = F.floor(F.col("part") / BUNDLE) * (1 << LOCAL_BITS) + number * (2 * tiers[-1]) + F.col("window")
    own = [c for c in pieces.columns if c != "turn"]
    return pieces.withColumn("part", part).join(before.withColumnRenamed("tier", "window"), ["part", "window"]).select(*own, step.cast("long").alias("step_group"))


def pack(docs: DataFrame, path: str | None = None, tiers: Sequence[int] = TIERS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group``."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_steps(stored(rows.mapInArrow(*_packed(path or public_tokenizers.path(VOCABULARY), tuple(tiers))), "pieces"), tiers)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
