"""The bigWig format as a Spark data source: signal along chromosomes in compressed blocks, with an index.

A file has a tree of chromosome names, blocks of intervals, a tree of the blocks' places (an R-tree) and
summaries at falling resolution. Reading plans with the upper levels of that tree only: filters on ``chrom``, ``start`` and ``stop`` prune it,
and each partition is a run of its nodes, whose blocks a task then finds and reads. Writing gives a folder with a whole file per partition of
rows in order; files appear when all tasks have succeeded, so a lost or repeated task leaves nothing behind. ``coalesce(1)`` before writing
gives one file.

Values are single precision, as the format has it. Nulls in a row leave it out; intervals that are out of order, overlap, are empty or beyond
32 bits are an error.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from larkspur.sources.storage import place

SCHEMA = "chrom string, start long, stop long, value float"
#: Intervals of a block, children of a node of either tree, bases of the finest summary and the factor to the next.
ITEMS, CHILDREN, FINEST, COARSER, LEVELS = 1_024, 256, 1_024, 4, 10
#: Intervals that make a block of even steps, and their longest; how hard blocks are packed.
EVEN, EVEN_SPAN, PACKED = 128, 1 << 15, 1
#: Stretches that a writer takes apart at once.
ROWS = 256
#: Nodes of a file's index that planning looks at, and bytes of one read.
PLANNED, READ_BYTES = 1_024, 4 << 20
#: Rows of a batch that is read.
READ_ROWS = 1 << 14
#: Nodes and blocks that a task remembers, as neighbouring regions ask for the same.
KEPT = 256
#: Bases of regions that a task works on at once, and the distance of regions that read their blocks together.
BASES, NEAR = 1 << 20, 1 << 14

# Marks and layouts of the format.
MARK, NAMES_MARK, PLACES_MARK = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER, ZOOM, SUMMARY = "IHHQQQHHQQIQ", "IIQQ", "Q4d"
NAMES_HEADER, PLACES_HEADER, NODE = "IIIIQQ", "IIQIIIIQII", "BBH"
LEAF, BRANCH, SECTION = "IIIIQQ", "IIIIQ", "IIIIIBBH"
BED_GRAPH, VARIABLE, FIXED = 1, 2, 3
RECORD = np.dtype([("chrom", "<u4"), ("start", "<u4"), ("stop", "<u4"), ("covered", "<u4"), ("low", "<f4"), ("high", "<f4"), ("sum", "<f4"), ("squares", "<f4")])


class Bounds(NamedTuple):
    """What filters leave: names (all, if None), and blocks that begin before ``before`` and end after ``after``."""

    chroms: frozenset[str] | None = None
    after: int = -1
    before: int = 1 << 33


def bounds_of(filters: Iterable[Filter]) -> Bounds:
    """What is certain to hold all rows that pass the filters."""
    found = Bounds()
    for f in filters:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == "chrom" and isinstance(f, (EqualTo, In)):
            names = frozenset(f.value if isinstance(f, In) else [f.value])
            found = found._replace(chroms=names if found.chroms is None else found.chroms & names)
        elif column in ("start", "stop") and getattr(f, "value", None) is not None:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                found = found._replace(after=max(found.after, f.value - (column == "stop")))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                found = found._replace(before=min(found.before, f.value + 1))
    return found


class Track:
    """An open file: its header, its names, and walks over its index."""

    def __init__(self, source: BinaryIO, path: str):
        self.source, self.path, self.read_bytes = source, path, 0
        raw = self._at(0, 64)
        self.order = "<" if raw[:4] == struct.pack("<I", MARK) else ">"
        head = struct.unpack(self.order + HEADER, raw) if len(raw) == 64 else (0,)
        if head[0] != MARK:
            raise ValueError(f"{path} is no bigWig file")
        self.names_at, self.index_at, self.packed = head[3], head[5], head[10] > 0
        self.root, self.nodes_seen, self.sections_seen = self.index_at + 48, {}, {}
        self.names = dict(self._names(self.names_at + 32))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        self.read_bytes += size
        return self.source.read(size)

    def _node(self, at: int, leaf: str, branch: str) -> tuple[bool, list[tuple]]:
        if at not in self.nodes_seen:
            is_leaf, _, count = struct.unpack(self.order + NODE, self._at(at, 4))
            item = struct.Struct(self.order + (leaf if is_leaf else branch))
            _kept(self.nodes_seen, at, (bool(is_leaf), list(item.iter_unpack(self._at(at + 4, count * item.size)))))
        return self.nodes_seen[at]

    def _names(self, at: int) -> Iterator[tuple[int, tuple[str, int]]]:
        width = struct.unpack(self.order + NAMES_HEADER, self._at(self.names_at, 32))[2]
        waiting = [at]
        while waiting:
            is_leaf, items = self._node(waiting.pop(), f"{width}sII", f"{width}sQ")
            for item in items:
                if is_leaf:
                    yield item[1], (item[0].rstrip(b"\0").decode(), item[2])
                else:
                    waiting.append(item[1])

    def _meets(self, item: tuple, bounds: Bounds, wanted: list[int] | None) -> bool:
        first, start, last, stop = item[:4]
        if wanted is not None and not any(first <= c <= last for c in wanted):
            return False
        return first != last or start < bounds.before and stop > bounds.after

    def _wanted(self, bounds: Bounds) -> list[int] | None:
        return None if bounds.chroms is None else [i for i, (name, _) in self.names.items() if name in bounds.chroms]

    def nodes(self, bounds: Bounds, most: int) -> list[int]:
        """The nodes of one level that hold what is wanted: the lowest level of at most about ``most``."""
        wanted, level = self._wanted(bounds), [self.root]
        while level:
            below = []
            for at in level:
                is_leaf, items = self._node(at, LEAF, BRANCH)
                if is_leaf:
                    return level
                below += [x[4] for x in items if self._meets(x, bounds, wanted)]
            if len(below) > most:
                return level
            level = below
        return level

    def blocks(self, nodes: Iterable[int], bounds: Bounds) -> Iterator[tuple[int, int]]:
        """Offset and size of the blocks below the nodes that may hold what is wanted, in order."""
        wanted, waiting = self._wanted(bounds), list(nodes)[::-1]
        while waiting:
            is_leaf, items = self._node(waiting.pop(), LEAF, BRANCH)
            met = [x for x in items if self._meets(x, bounds, wanted)]
            if is_leaf:
                yield from (x[4:] for x in met)
            else:
                waiting += [x[4] for x in reversed(met)]

    def intervals(self, blocks: Iterable[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Chromosome number, starts, stops and values of each block; neighbours come by one read."""
        for first, last, sizes in _stretches(blocks):
            if len(sizes) == 1 and first in self.sections_seen:
                yield self.sections_seen[first]
                continue
            raw, at = self._at(first, last - first), 0
            for size in sizes:
                section = self._section(raw[at : at + size])
                _kept(self.sections_seen, first + at, section)
                yield section
                at += size

    def _section(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        raw = zlib.decompress(raw) if self.packed else raw
        chrom, start, _, step, span, kind, _, count = struct.unpack_from(self.order + SECTION, raw)
        words = np.frombuffer(raw, self.order + "u4", offset=24)
        per = {BED_GRAPH: 3, VARIABLE: 2, FIXED: 1}[kind]
        words = words[: count * per].reshape(count, per)
        values = np.ascontiguousarray(words[:, -1]).view(self.order + "f4").astype(np.float32)
        starts = (start + step * np.arange(count) if kind == FIXED else words[:, 0]).astype(np.int64)
        return chrom, starts, words[:, 1].astype(np.int64) if kind == BED_GRAPH else starts + span, values


def _sections(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Where blocks of up to ITEMS intervals begin and end, and whether theirs are EVEN or more of one length without gaps, which need no places."""
    if not len(starts):
        return
    size = stops - starts
    heads = np.r_[0, np.flatnonzero((starts[1:] != stops[:-1]) | (size[1:] != size[:-1])) + 1, len(starts)]
    even = np.flatnonzero((np.diff(heads) >= EVEN) & (size[heads[:-1]] <= EVEN_SPAN))
    at = 0
    for first, last in [*zip(heads[even].tolist(), heads[even + 1].tolist()), (len(starts), len(starts))]:
        yield from ((i, min(i + ITEMS, first), False) for i in range(at, first, ITEMS))
        yield from ((i, min(i + ITEMS, last), True) for i in range(first, last, ITEMS))
        at = last


def _kept(seen: dict, key: int, value: object) -> None:
    """Remember the last KEPT values."""
    if len(seen) >= KEPT:
        seen.pop(next(iter(seen)))
    seen[key] = value


def _stretches(blocks: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """First byte, end and sizes of blocks that are neighbours, of up to READ_BYTES (or one block)."""
    first, last, sizes = 0, 0, []
    for at, size in blocks:
        if sizes and (at != last or last + size - first > READ_BYTES):
            yield first, last, sizes
            sizes = []
        first, last = (first if sizes else at), at + size
        sizes.append(size)
    if sizes:
        yield first, last, sizes


def files_of(path: str) -> list[str]:
    """A file, or the files of a folder."""
    system, inner = place(path)
    about = system.get_file_info(inner)
    if about.is_file:
        return [path]
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.is_file and x.base_name.endswith((".bw", ".bigwig", ".bigWig"))]
    return [f"{path.rstrip('/')}/{name}" for name in sorted(names)]


@dataclass
class Nodes(InputPartition):
    path: str
    nodes: list[int]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.bounds, self.parts = options["path"], int(options.get("nodes", PLANNED)), Bounds(), int(options.get("parts", PLANNED))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Blocks are pruned; rows of the blocks that are left are still filtered by Spark."""
        self.bounds = bounds_of(filters)
        return filters

    def partitions(self) -> list[Nodes]:
        found = []
        for path in files_of(self.path):
            system, inner = place(path)
            with system.open_input_file(inner) as source:
                nodes = Track(source, path).nodes(self.bounds, self.most)
            found += [(path, n) for n in nodes]
        # Neighbours share a task where there are more nodes than tasks that a cluster needs.
        each, out = -(-len(found) // self.parts), []
        for path, n in found:
            if out and out[-1].path == path and len(out[-1].nodes) < each:
                out[-1].nodes.append(n)
            else:
                out.append(Nodes(path, [n]))
        return out

    def read(self, part: Nodes | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, inner = place(part.path)
        with system.open_input_file(inner) as source:
            track = Track(source, part.path)
            held, rows = [], 0
            for section in track.intervals(track.blocks(part.nodes, self.bounds)):
                if held and (held[0][0] != section[0] or rows >= READ_ROWS):
                    yield self._rows(track, held)
                    held, rows = [], 0
                held.append(section)
                rows += len(section[1])
            if held:
                yield self._rows(track, held)

    def _rows(self, track: Track, sections: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate([x[i] for x in sections]) for i in (1, 2, 3)]
        name = pa.array([track.names[sections[0][0]][0]], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int32)))
        return pa.RecordBatch.from_arrays([name, *map(pa.array, columns)], names=["chrom", "start", "stop", "value"])


class Spool:
    """Blocks of a file to be, on disk, with their places."""

    def __init__(self) -> None:
        self.data, self.places, self.largest = tempfile.SpooledTemporaryFile(64 << 20), [], 0

    def add(self, first: tuple[int, int], last: tuple[int, int], raw: bytes) -> None:
        packed = zlib.compress(raw, PACKED)
        self.largest = max(self.largest, len(raw))
        self.places.append((first[0], first[1], last[0], last[1], self.data.tell(), len(packed)))
        self.data.write(packed)

    def size(self) -> int:
        return self.data.tell()

    def index(self, data_at: int, index_at: int) -> bytes:
        """The tree of the blocks' places, if data and index stand at these offsets."""
        items = [(*p[:4], data_at + p[4], p[5]) for p in self.places]
        levels = [items]
        while len(levels[-1]) > CHILDREN:
            groups = [levels[-1][i : i + CHILDREN] for i in range(0, len(levels[-1]), CHILDREN)]
            levels.append([(g[0][0], g[0][1], max(g, key=lambda x: (x[2], x[3]))[2], max(x[3] for x in g), 0) for g in groups])
        head = (items[0][:2] + (max(x[2] for x in items), max(x[3] for x in items))) if items else (0, 0, 0, 0)
        out = [struct.pack("<" + PLACES_HEADER, PLACES_MARK, CHILDREN, len(items), *head, data_at + self.size(), ITEMS, 0)]
        at = index_at + 48
        for depth, level in reversed(list(enumerate(levels))):
            shape = "<" + (BRANCH if depth else LEAF)
            nodes = [level[i : i + CHILDREN] for i in range(0, max(1, len(level)), CHILDREN)]
            at += sum(4 + len(n) * struct.calcsize(shape) for n in nodes)
            child, k = at, 0
            for n in nodes:
                raw = struct.pack("<" + NODE, depth == 0, 0, len(n))
                for x in n:
                    raw += struct.pack(shape, *x[:4], child) if depth else struct.pack(shape, *x)
                    if depth:
                        child += 4 + len(levels[depth - 1][k * CHILDREN : (k + 1) * CHILDREN]) * struct.calcsize("<" + (BRANCH if depth > 1 else LEAF))
                        k += 1
                out.append(raw)
        return b"".join(out)


def names_tree(names: list[tuple[str, int]], at: int) -> bytes:
    """The tree of chromosome names in order, numbered from 0, if it stands at that offset."""
    width = max([len(n.encode()) for n, _ in names], default=1)
    levels = [[(n.encode(), i, size) for i, (n, size) in enumerate(names)]]
    while len(levels[-1]) > CHILDREN:
        levels.append([(levels[-1][i][0], 0) for i in range(0, len(levels[-1]), CHILDREN)])
    out, at = [struct.pack("<" + NAMES_HEADER, NAMES_MARK, CHILDREN, width, 8, len(names), 0)], at + 32
    for depth, level in reversed(list(enumerate(levels))):
        nodes = [level[i : i + CHILDREN] for i in range(0, max(1, len(level)), CHILDREN)]
        at += sum(4 + len(n) * (width + 8) for n in nodes)
        child, k = at, 0
        for n in nodes:
            raw = struct.pack("<" + NODE, depth == 0, 0, len(n))
            for x in n:
                raw += x[0].ljust(width, b"\0") + (struct.pack("<Q", child) if depth else struct.pack("<II", *x[1:]))
                if depth:
                    child += 4 + len(levels[depth - 1][k * CHILDREN : (k + 1) * CHILDREN]) * (width + 8)
                    k += 1
            out.append(raw)
    return b"".join(out)


def summed(records: np.ndarray, bases: int) -> np.ndarray:
    """Summaries in order, added up by bins of ``bases``."""
    if not len(records):
        return records
    key = records["start"].astype(np.int64) // bases + (records["chrom"].astype(np.int64) << 33)
    starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    out = records[starts].copy()
    out["stop"] = records["stop"][np.r_[starts[1:], len(records)] - 1]
    for name in ("covered", "sum", "squares"):
        out[name] = np.add.reduceat(records[name].astype(np.float64), starts)
    out["low"], out["high"] = np.minimum.reduceat(records["low"], starts), np.maximum.reduceat(records["high"], starts)
    return out


class TrackFile:
    """A file that is being written from intervals in order of name and start."""

    def __init__(self) -> None:
        self.names: list[list] = []
        self.blocks, self.last, self.fine, self.held, self.total = Spool(), None, [], [], np.array([0, np.inf, -np.inf, 0, 0], float)

    def add(self, chrom: str, starts: np.ndarray, stops: np.ndarray, values: np.ndarray, length: int = 0) -> None:
        before = self.names[-1][0].encode() if self.names else None
        if before is None or before < chrom.encode():
            self._flush()
            self.names.append([chrom, 0])
            self.last = 0
        elif before != chrom.encode():
            raise ValueError(f"{chrom} comes after {self.names[-1][0]}")
        ends = np.r_[self.last, stops[:-1]]
        if (starts < ends).any() or (stops <= starts).any() or (len(stops) and stops[-1] >= 1 << 32):
            raise ValueError(f"intervals of {chrom} overlap, are empty, out of order or beyond 32 bits")
        self.last = int(stops[-1]) if len(stops) else self.last
        self.names[-1][1] = max(self.names[-1][1], self.last, length)
        values = values.astype(np.float32)
        self.fine.append(self._fine(starts, stops, values))
        self.held.append((starts, stops, values))
        if sum(len(x[0]) for x in self.held) >= 64 * ITEMS:
            self._flush(whole=False)

    def _fine(self, starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> np.ndarray:
        first = starts // FINEST
        n = (stops - 1) // FINEST - first + 1
        own = np.repeat(np.arange(len(starts)), n)
        bin_ = first[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(own):
            return np.zeros(0, RECORD)
        begin, end = np.maximum(starts[own], bin_ * FINEST), np.minimum(stops[own], (bin_ + 1) * FINEST)
        covered, v = (end - begin).astype(float), values[own].astype(float)
        heads = np.flatnonzero(np.r_[True, np.diff(bin_) != 0])
        records = np.zeros(len(heads), RECORD)
        records["chrom"], records["start"], records["stop"] = len(self.names) - 1, begin[heads], end[np.r_[heads[1:], len(own)] - 1]
        records["low"], records["high"] = np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads)
        sums = [np.add.reduceat(x, heads) for x in (covered, covered * v, covered * v * v)]
        records["covered"], records["sum"], records["squares"] = sums
        added = [x.sum() for x in sums]
        self.total = np.array([self.total[0] + added[0], min(self.total[1], v.min()), max(self.total[2], v.max()), self.total[3] + added[1], self.total[4] + added[2]])
        return records

    def _flush(self, whole: bool = True) -> None:
        if not self.held:
            return
        starts, stops, values = (np.concatenate(x) for x in zip(*self.held))
        upto = len(starts) if whole else len(starts) // ITEMS * ITEMS
        chrom = len(self.names) - 1
        for i, j, fixed in _sections(starts[:upto], stops[:upto]):
            first, last, span = int(starts[i]), int(stops[j - 1]), int(stops[i] - starts[i])
            words = values[i:j].view("<u4") if fixed else np.column_stack([starts[i:j].astype("<u4"), stops[i:j].astype("<u4"), values[i:j].view("<u4")])
            head = struct.pack("<" + SECTION, chrom, first, last, *((span, span, FIXED) if fixed else (0, 0, BED_GRAPH)), 0, j - i)
            self.blocks.add((chrom, first), (chrom, last), head + words.tobytes())
        self.held = [(starts[upto:], stops[upto:], values[upto:])] if upto < len(starts) else []

    def _zooms(self) -> list[tuple[int, Spool]]:
        records, found = summed(np.concatenate(self.fine) if self.fine else np.zeros(0, RECORD), FINEST), []
        for k in range(LEVELS):
            spool = Spool()
            cuts = [i for c in np.split(np.arange(len(records)), np.flatnonzero(np.diff(records["chrom"])) + 1) for i in np.array_split(c, max(1, -(-len(c) // ITEMS)))]
            for part in (records[c] for c in cuts if len(c)):
                spool.add((int(part[0]["chrom"]), int(part[0]["start"])), (int(part[-1]["chrom"]), int(part[-1]["stop"])), part.tobytes())
            found.append((FINEST * COARSER**k, spool))
            if len(records) <= CHILDREN:
                break
            records = summed(records, FINEST * COARSER ** (k + 1))
        return found

    def finish(self, sink: BinaryIO) -> None:
        """Write the whole file, front to back."""
        self._flush()
        zooms = self._zooms()
        names_at = 64 + 24 * len(zooms) + 40
        names = names_tree([tuple(x) for x in self.names], names_at)
        data_at = names_at + len(names)
        index_at = data_at + 8 + self.blocks.size()
        index = self.blocks.index(data_at + 8, index_at)
        at, placed = index_at + len(index), []
        for bases, spool in zooms:
            raw = spool.index(at + 4, at + 4 + spool.size())
            placed.append((bases, at, at + 4 + spool.size(), spool, raw))
            at += 4 + spool.size() + len(raw)
        largest = max([self.blocks.largest, *(z.largest for _, z in zooms)])
        sink.write(struct.pack("<" + HEADER, MARK, 4, len(zooms), names_at, data_at, index_at, 0, 0, 0, names_at - 40, largest, 0))
        for bases, start, tree, _, _ in placed:
            sink.write(struct.pack("<" + ZOOM, bases, 0, start, tree))
        low, high = (self.total[1], self.total[2]) if self.total[0] else (0.0, 0.0)
        sink.write(struct.pack("<" + SUMMARY, int(self.total[0]), low, high, self.total[3], self.total[4]))
        sink.write(names)
        sink.write(struct.pack("<Q", len(self.blocks.places)))
        self._copy(self.blocks, sink)
        sink.write(index)
        for _, _, _, spool, raw in placed:
            sink.write(struct.pack("<I", sum(1 for _ in spool.places)))
            self._copy(spool, sink)
            sink.write(raw)

    @staticmethod
    def _copy(spool: Spool, sink: BinaryIO) -> None:
        spool.data.seek(0)
        while block := spool.data.read(READ_BYTES):
            sink.write(block)
        spool.data.close()


@dataclass
class Written(WriterCommitMessage):
    name: str


def flat_stretches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, stop and value of all runs of ``start, ends, values``: a run begins where the one before it ends."""
    lists = batch.column("ends")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    stops, values = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, batch.column("values")))
    starts, heads = np.r_[0, stops[:-1]][: len(stops)], (np.cumsum(sizes) - sizes)[sizes > 0]
    starts[heads] = batch.column("start").to_numpy(zero_copy_only=False)[sizes > 0]
    return np.repeat(np.arange(len(sizes)), sizes), starts, stops, values


class Writer(DataSourceArrowWriter):
    """A file for each partition that has rows, under a name of its own until all are whole."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        track, any_ = TrackFile(), False
        for batch in batches:
            packed = "ends" in batch.schema.names
            columns = ("chrom", "start", "ends", "values") if packed else ("chrom", "start", "stop", "value")
            batch = batch.filter(np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns]))
            rows = ROWS if packed else max(1, batch.num_rows)
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                any_ = True
                self._add(track, part, packed)
        if not any_:
            return Written("")
        system, inner = place(self.path)
        name = f"{track.names[0][0]}-{uuid.uuid4().hex}.bw"
        system.create_dir(f"{inner}/_temporary", recursive=True)
        with system.open_output_stream(f"{inner}/_temporary/{name}") as sink:
            track.finish(sink)
        return Written(name)

    def _add(self, track: TrackFile, batch: pa.RecordBatch, packed: bool) -> None:
        row, starts, stops, values = flat_stretches(batch) if packed else (np.arange(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "value")))
        chroms = batch.column("chrom").dictionary_encode()
        code = chroms.indices.to_numpy()[row]
        lengths = np.nan_to_num(batch.column("length").to_numpy(zero_copy_only=False)) if "length" in batch.schema.names else np.zeros(batch.num_rows)
        cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                track.add(chroms.dictionary[int(code[a])].as_py(), starts[a:b].astype(np.int64), stops[a:b].astype(np.int64), values[a:b], int(lengths[row[a]]))

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = place(self.path)
        system.create_dir(inner, recursive=True)
        old = files_of(self.path) if self.overwrite else []
        for m in messages:
            if m and m.name:
                system.move(f"{inner}/_temporary/{m.name}", f"{inner}/{m.name}")
        for path in old:
            system.delete_file(place(path)[1])
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = place(self.path)
        if system.get_file_info(f"{inner}/_temporary").type:
            system.delete_dir(f"{inner}/_temporary")


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def read_bigwig(spark: SparkSession, path: str, nodes: int = PLANNED) -> DataFrame:
    """``chrom, start, stop, value`` of a file or of the files of a folder; filters prune what is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWig)
    parts = 8 * spark.sparkContext.defaultParallelism
    return spark.read.format("bigwig").option("nodes", nodes).option("parts", parts).load(path)


def write_bigwig(signal: DataFrame, path: str, sizes: DataFrame | None = None, files: int | None = None) -> None:
    """Intervals ``chrom, start, stop, value`` that don't overlap as bigWig files, each of a range of places.

    ``sizes(chrom, length)`` gives the lengths that files state; without it they end with the last interval.
    """
    spark = signal.sparkSession
    spark.dataSource.register(BigWig)
    rows = signal.select("chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("value").cast("float").alias("value"))
    if sizes is not None:
        rows = rows.join(sizes.select("chrom", F.col("length").cast("long").alias("length")), "chrom", "left")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "chrom", "start").sortWithinPartitions("chrom", "start").write.format("bigwig").mode("overwrite").save(path)


def write_stretches(stretches: DataFrame, path: str, sizes: DataFrame | None = None) -> None:
    """The same of ``chrom, start, ends, values``, runs without gaps that begin where the one before ends; rows lie in ranges of increasing places, and stay there."""
    spark = stretches.sparkSession
    spark.dataSource.register(BigWig)
    if sizes is not None:
        stretches = stretches.join(F.broadcast(sizes.select("chrom", F.col("length").cast("long").alias("length"))), "chrom", "left")
    stretches.write.format("bigwig").mode("overwrite").save(path)


def tracks(regions: DataFrame, path: str) -> DataFrame:
    """Regions ``chrom, start, stop`` and any further columns with ``track``, a value per base from a bigWig file or folder, 0 where there is none.

    Regions are dealt by place, and each task finds its regions' blocks in the index: what is read follows the regions, not the file.
    """
    spark, given = regions.sparkSession, [(name, _extents(name)) for name in files_of(path)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = regions.withColumn("track", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Track] = {}
        for batch in batches:
            upto = np.cumsum(batch.column("stop").to_numpy() - batch.column("start").to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BASES, "right")))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, _tracks(part, given, opened)], names=[*batch.schema.names, "track"])
                at = end
        for track in opened.values():
            track.source.close()

    sound = regions.filter("chrom IS NOT NULL AND start >= 0 AND start < stop")
    return sound.repartitionByRange(parts, "chrom", "start").sortWithinPartitions("chrom", "start").mapInArrow(run, schema)


def _extents(path: str) -> dict[str, tuple[int, int]]:
    """The range of places that a file has of each name, by the first node of its index."""
    system, inner = place(path)
    found: dict[str, tuple[int, int]] = {}
    with system.open_input_file(inner) as source:
        track = Track(source, path)
        for first, start, last, stop in (x[:4] for x in track._node(track.root, LEAF, BRANCH)[1]):
            for c in range(first, last + 1):
                if c in track.names:
                    low, high = found.get(track.names[c][0], (1 << 33, -1))
                    found[track.names[c][0]] = min(low, start if c == first else 0), max(high, stop if first == last else 1 << 33)
    return found


def _tracks(batch: pa.RecordBatch, given: list[tuple[str, dict]], opened: dict[str, Track]) -> pa.Array:
    """A value per base of each region of a batch in order; neighbouring regions read their blocks together."""
    first, last = (batch.column(c).to_numpy() for c in ("start", "stop"))
    chroms = batch.column("chrom").dictionary_encode()
    code, names = chroms.indices.to_numpy(), chroms.dictionary.to_pylist()
    ends = np.r_[0, np.cumsum(last - first)]
    flat = np.zeros(ends[-1])
    heads = [0]
    for i in range(1, len(first)):
        reach = last[i - 1] if i - 1 == heads[-1] else max(reach, last[i - 1])
        if code[i] != code[i - 1] or first[i] > reach + NEAR:
            heads.append(i)
    used = set()
    for a, b in zip(heads, [*heads[1:], len(first)]):
        name, low, high = names[code[a]], int(first[a:b].min()), int(last[a:b].max())
        for path, extents in given:
            if name not in extents or extents[name][0] >= high or extents[name][1] <= low:
                continue
            used.add(path)
            if path not in opened:
                system, inner = place(path)
                opened[path] = Track(system.open_input_file(inner), path)
            track = opened[path]
            met = [x[1:] for x in track.intervals(track.blocks([track.root], Bounds(frozenset([name]), low, high))) if track.names[x[0]][0] == name]
            if met:
                starts, stops, values = (np.concatenate(x) for x in zip(*met))
                _fill(flat, ends[a:b], first[a:b], last[a:b], starts, stops, values)
    for path in [x for x in opened if x not in used]:
        opened.pop(path).source.close()
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers 0, 1, ... below each of ``sizes``, one after another, and whose they are."""
    whose = np.repeat(np.arange(len(sizes)), sizes)
    return whose, np.arange(len(whose)) - (np.cumsum(sizes) - sizes)[whose]


def _fill(flat: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> None:
    """Put the values of intervals in order under the regions that they meet; ``at`` is where a region's bases begin."""
    low, high = np.searchsorted(stops, first, "right"), np.searchsorted(starts, last, "left")
    region, k = _spread(np.maximum(high - low, 0))
    of = low[region] + k
    begin, end = np.maximum(starts[of], first[region]), np.minimum(stops[of], last[region])
    pair, i = _spread(np.maximum(end - begin, 0))
    flat[(at[region] + begin - first[region])[pair] + i] = values[of][pair]
