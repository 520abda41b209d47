"""Readers and writers of genomic text formats, with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.intervals import BIN, center_regions, region_name
from larkspur.operators.motifs import meme_text, merged_names, parsed_meme
from larkspur.functions.sequence import on_strand
from larkspur.operators.sequences import region_sequences
from larkspur.sources.bigwig import flat_stretches, write_stretches
from larkspur.sources.storage import place

BED3 = "chrom string, start long, stop long"
BED5 = f"{BED3}, strand string, concept string"
NARROW_PEAK = f"{BED3}, name string, score int, strand string, signal double, p double, q double, summit int"
FAI = "chrom string, length long, offset long, line_bases int, line_width int"
CONSENSUS = "motif string, consensus string"
BEDGRAPH = f"{BED3}, value double"
STRETCHES = "chrom string, start long, ends array<long>, values array<double>"
PREDICTIONS = "Pred int, Truth int"
#: Bases of a chunk of a genome.
CHUNK = 1 << 16
#: Values of signal that are worked on at once.
VALUES = 1 << 19
#: Places of a chromosome lie below this where several are put on one line; a multiple of the bins.
FAR = BIN << 24
#: Bytes of one read, and bytes between ranges that are read along rather than skipped.
READ_BYTES, GAP = 4 << 20, 4 << 10


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    """Tab-separated rows; lines that begin with ``#`` are comments."""
    return spark.read.schema(schema).options(sep="\t", header=header, comment="#").csv(path)


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, FAI).select("chrom", "length")


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``chrom, chunk_start, seq``: each record's letters, upper-cased, in chunks."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    whole = records.select(head.alias("chrom"), body.alias("body"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(chunk)))
    return whole.withColumn("at", starts).select("chrom", F.col("at").cast("long").alias("chunk_start"), F.substring(F.col("body"), F.col("at") + 1, F.lit(chunk)).alias("seq"))


def read_fasta_windows(spark: SparkSession, path: str, window: int | None = None) -> DataFrame:
    """``name, seq``: one row per record; an error if a record isn't of the given length."""
    records = read_fasta(spark, path, 1 << 30).select(F.col("chrom").alias("name"), "seq")
    return records if window is None else records.filter(F.assert_true(F.length("seq") == window, F.concat(F.lit("length of "), F.col("name"))).isNull())


def read_meme(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``motif, pos, a, c, g, t``."""
    return parsed_meme(spark.read.option("lineSep", "MOTIF ").text(path))


def read_meme_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files' motifs; a name that comes again, in the order of files, gets a suffix."""
    rows = None
    for i, path in enumerate(paths):
        one = read_meme(spark, path).withColumn("file", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    names = merged_names(rows.select("motif", "file").distinct(), "motif", "file")
    return rows.join(names, ["motif", "file"]).select(F.col("unique_name").alias("motif"), "pos", "a", "c", "g", "t")


def read_consensus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, CONSENSUS).withColumn("consensus", F.upper("consensus"))


def folder_names(folder: Column) -> list[Column]:
    """``concept`` and ``control`` of a folder named ``<concept>_control_<control>``; what tells of a replicate is left out."""
    parts = F.split(F.regexp_replace(folder, "control_rep[0-9]_insert_", ""), "_control_")
    return [parts[0].alias("concept"), parts[1].alias("control")]


def read_prediction_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """Prediction files of folders named ``<concept>_control_<control>``, with both names as columns."""
    folder = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^folder=", "")
    rows = read_tsv(spark, pattern, PREDICTIONS, header=True).select("Pred", "Truth", folder.alias("folder"))
    return rows.select(*folder_names(F.col("folder")), F.col("Pred").alias("pred"), F.col("Truth").alias("truth"))


def write_prediction_folders(predictions: DataFrame, path: str) -> None:
    """``concept, control, pred, truth`` as tab-separated files of ``Pred`` and ``Truth``, in a folder for each concept and control that names both."""
    folder = F.concat("concept", F.lit("_control_"), "control").alias("folder")
    named = predictions.select(F.col("pred").alias("Pred"), F.col("truth").alias("Truth"), folder)
    named.write.mode("overwrite").partitionBy("folder").options(sep="\t", header=True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``pred, truth`` and any further columns, in a folder for each ``concept`` and ``control``."""
    predictions.write.mode("overwrite").partitionBy("concept", "control").parquet(path)


def write_run(path: str, tables: dict[str, DataFrame]) -> None:
    """The tables of a run (directions, scores, ...), each a folder of Parquet files under ``path``."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_indexed_fasta(spark: SparkSession, path: str, index: str, chunk: int = CHUNK, where: Column | str | None = None) -> DataFrame:
    """``chrom, chunk_start, seq`` of an uncompressed FASTA file with its .fai index, upper-cased, in chunks.

    The index is a table like others: its rows become chunks of as many whole lines as ``chunk`` bases hold (or one), each a range of
    bytes, and tasks read their ranges. ``where``, a condition on ``chrom`` and ``chunk_start``, picks chunks before anything is read.
    """
    whole = F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.col("line_bases"))) * F.col("line_bases")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, whole.cast("long")))
    records = read_tsv(spark, index, FAI).withColumn("file", F.lit(path)).filter("length > 0 AND line_bases > 0")
    chunks = records.withColumn("size", whole.cast("long")).withColumn("chunk_start", starts)
    chunks = chunks if where is None else chunks.filter(where)
    return _fasta_ranges(chunks.withColumn("stop", F.least("length", F.col("chunk_start") + F.col("size"))), "chunk_start").select("chrom", "chunk_start", "seq")


def index_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, chrom, length, offset, line_bases, line_width``: the index of a FASTA file or of all files of a folder, a task for each file.

    A record whose lines differ in length (but for the last) is an error, as its letters can't be found by arithmetic.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                yield pa.RecordBatch.from_pylist(list(fasta_records(name)), pa.schema([("file", pa.string()), ("chrom", pa.string()), *[(c, pa.int64()) for c in ("length", "offset", "line_bases", "line_width")]]))

    return found.mapInArrow(run, "file string, chrom string, length long, offset long, line_bases long, line_width long")


def fasta_records(path: str) -> Iterator[dict]:
    """The index entries of one file, read in blocks of whole lines."""
    system, inner = place(path)
    with system.open_input_stream(inner) as source:
        rest, base, record, ended = b"", 0, None, False
        while not ended:
            more = source.read(READ_BYTES)
            ended = not more
            raw = rest + more
            cut = len(raw) if ended else raw.rfind(b"\n") + 1
            block, rest = np.frombuffer(raw[:cut], np.uint8), raw[cut:]
            stops = np.flatnonzero(block == 10) + 1
            stops = np.r_[stops, len(block)] if len(block) and (not len(stops) or stops[-1] < len(block)) else stops
            starts = np.r_[0, stops][: len(stops)].astype(np.int64)
            for first, last in _headed(block, starts):
                if first >= 0:
                    if record:
                        yield record
                    name = raw[starts[first] + 1 : stops[first]].split()
                    record = {"file": path, "chrom": name[0].decode() if name else "", "length": 0, "offset": base + int(stops[first]), "line_bases": 0, "line_width": 0, "short": False}
                if record:
                    _lengthen(record, block, starts[first + 1 : last], stops[first + 1 : last])
            base += cut
        if record:
            yield record


def _headed(block: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """The lines of each record in a block: that of its head (-1 if it is in an earlier block) and the end."""
    heads = np.flatnonzero(block[starts] == ord(">")) if len(starts) else np.zeros(0, int)
    edges = np.r_[-1, heads, len(starts)].tolist()
    return ((a, b) for a, b in zip(edges, edges[1:]) if a >= 0 or b > 0)


def _lengthen(record: dict, block: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
    if not len(starts):
        return
    ends = stops - (block[stops - 1] == 10)
    bases = ends - starts - ((ends > starts) & (block[np.maximum(ends - 1, 0)] == 13))
    if not record["line_bases"]:
        record["line_bases"], record["line_width"] = int(bases[0]), int(stops[0] - starts[0])
    short = bases < record["line_bases"]
    if (bases > record["line_bases"]).any() or (record["short"] and bases.any()) or short[:-1].any() and bases[np.flatnonzero(short)[0] + 1 :].any():
        raise ValueError(f"{record['file']}: lines of {record['chrom']} differ in length")
    record["short"] |= bool(short.any())
    record["length"] += int(bases.sum())


def read_fasta_regions(regions: DataFrame, records: DataFrame) -> DataFrame:
    """Regions ``chrom, start, stop`` and any further columns with ``seq`` from FASTA files, on their ``strand`` if they have one.

    ``records`` are those of ``index_fasta``. Only the bytes of the regions are read, neighbouring ones together. Regions that are
    empty or beyond their chromosome are left out.
    """
    met = regions.filter("start >= 0 AND start < stop").join(records.filter("length > 0 AND line_bases > 0"), "chrom").filter("stop <= length")
    found = _fasta_ranges(met, "start")
    return found.select(*regions.columns, (on_strand(F.col("seq"), F.col("strand")) if "strand" in regions.columns else F.col("seq")).alias("seq"))


def _fasta_ranges(rows: DataFrame, start: str) -> DataFrame:
    """Rows of ``start``, ``stop`` and the index's columns with ``seq``: their bytes are found by arithmetic and read in order of places."""
    byte = lambda at: F.col("offset") + F.floor(at / F.col("line_bases")) * F.col("line_width") + at % F.col("line_bases")
    ranged = rows.withColumns({"from__": byte(F.col(start)), "to__": byte(F.col("stop") - 1) + 1})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ranged.withColumn("seq", F.lit("")).schema

    return ranged.repartitionByRange(parts, "file", "from__").sortWithinPartitions("file", "from__").mapInArrow(range_batches, schema)


def range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the letters of their ranges of bytes; ranges that are neighbours come by one read."""
    source, opened = None, None
    for batch in batches:
        files, first, last = (batch.column(c).to_pylist() for c in ("file", "from__", "to__"))
        i = 0
        while i < len(first):
            j, end = i + 1, last[i]
            while j < len(first) and files[j] == files[i] and first[j] <= end + GAP and max(end, last[j]) - first[i] <= READ_BYTES:
                j, end = j + 1, max(end, last[j])
            if files[i] != opened:
                if source:
                    source.close()
                opened = files[i]
                system, inner = place(opened)
                source = system.open_input_file(inner)
            source.seek(first[i])
            block = source.read(end - first[i])
            seqs = [block[a - first[i] : b - first[i]].translate(None, b"\r\n").upper().decode() for a, b in zip(first[i:j], last[i:j])]
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(seqs, pa.string())], names=[*batch.schema.names, "seq"])
            i = j
    if source:
        source.close()


def read_source(spark: SparkSession, path: str, genome: DataFrame | None = None, window: int | None = None) -> DataFrame:
    """``name, seq`` by the file's kind: records of ``.fa`` or ``.fasta``, or the ``genome``'s sequences at the regions of a ``.bed``."""
    if path.endswith((".fa", ".fasta")):
        return read_fasta_windows(spark, path, window)
    if path.endswith(".bed") and genome is not None:
        regions = read_tsv(spark, path, BED3)
        regions = regions if window is None else center_regions(regions, window)
        found = region_sequences(regions.distinct(), genome)
        return found.select(region_name(F.col("chrom"), F.col("start"), F.col("stop")).alias("name"), "seq")
    raise ValueError("sources are .fa, .fasta, or .bed with a genome")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(sep="\t").csv(path)


def write_bedgraph(signal: DataFrame, path: str) -> None:
    """``chrom, start, stop, value`` in files of increasing places."""
    write_tsv(signal.select("chrom", "start", "stop", "value").orderBy("chrom", "start"), path)


def write_meme(pwm: DataFrame, path: str, background: float = 0.25) -> None:
    """A folder of minimal MEME files, one for each partition of motifs, each with a head."""
    head = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\n" + " ".join(f"{b} {background}" for b in "ACGT") + "\n"

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array([head] * (i == 0) + batch.column("text").to_pylist(), pa.string())], names=["value"])

    meme_text(pwm).select("text").mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_signal(regions: DataFrame, arrays: str, path: str, smooth: bool = False, width: int = 10, kind: str = "bedgraph", sizes: DataFrame | None = None) -> DataFrame:
    """Arrays of regions as one track: first region wins, and if asked a moving average within each block of overlapping regions.

    ``kind`` is ``bedgraph`` or ``bigwig``. Returns ``chrom, start, stop, value`` as written, runs of equal values being one interval.
    """
    if kind not in ("bedgraph", "bigwig"):
        raise ValueError("kind is bedgraph or bigwig")
    found = signal_stretches(signal_pieces(regions, arrays), width if smooth else 0)
    runs = _rows(found)
    if kind == "bigwig":
        write_stretches(found, path, sizes)
    else:
        write_bedgraph(runs, path)
    return runs


def signal_pieces(regions: DataFrame, arrays: str) -> DataFrame:
    """``chrom, start, region_id, values``: the array of each region where it stands.

    Longer arrays reach out evenly on both sides; regions that then begin before 0 are left out, as is an odd surplus.
    """
    surplus = F.size(arrays) - (F.col("stop") - F.col("start"))
    wide = regions.withColumn("surplus", surplus).filter("surplus >= 0 AND surplus % 2 = 0").withColumn("start", F.col("start") - F.floor(F.col("surplus") / 2))
    return wide.filter((F.col("start") >= 0) & F.col("chrom").isNotNull() & (F.size(arrays) > 0)).select("chrom", "start", "region_id", F.col(arrays).cast("array<double>").alias("values"))


def signal_stretches(pieces: DataFrame, width: int = 0) -> DataFrame:
    """``chrom, start, ends, values`` of pieces: stretches without a gap, as runs of equal values and their ends, in ranges of increasing places.

    Where pieces overlap, the first by start and ``region_id`` wins. With a ``width``, the values are the sums of so many neighbouring values of a block over ``width``, zeros beyond
    the block's ends; blocks are of overlapping pieces, and those that only touch are blocks of their own. Pieces are cut at bins of positions, and a bin is given the few values
    beyond its ends that its sums need. All pieces over a position meet in its bin, so arrays are moved once, and a task holds what a bin keeps; stretches end with their bin.
    Without a width, nulls are gaps.
    """
    before, after = (width // 2, width - width // 2 - 1) if width else (0, 0)
    stop = F.col("start") + F.size("values")
    first, last = F.greatest(F.floor((F.col("start") - after) / BIN), F.lit(0)), F.floor((stop - 1 + before) / BIN)
    part = lambda b, at, values: F.struct(b.cast("long").alias("bin"), at.cast("long").alias("at"), values.alias("values"))

    def cut(b: Column) -> Column:
        low, high = F.greatest(F.col("start"), b * BIN - before), F.least(stop, (b + 1) * BIN + after)
        return part(b, low, F.slice("values", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))

    parts = F.when(first == last, F.array(part(first, F.col("start"), F.col("values")))).otherwise(F.transform(F.sequence(first, last), cut))
    rows = pieces.select("chrom", "start", "region_id", F.explode(parts).alias("part")).select("chrom", "part.bin", "start", "region_id", "part.at", "part.values")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "chrom", "bin").sortWithinPartitions("chrom", "bin", "start", "region_id").select("chrom", "bin", "at", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reached = None, None
        for batch in (x for b in batches for x in _by_values(b)):
            own, reached = _kept(batch, reached, before, after)
            held = own if held is None else Kept(*map(np.concatenate, zip(held, own)))
            upto = int(np.flatnonzero(held.new)[-1])  # the last bin may go on
            if upto:
                done, held = held.cut(upto)
                yield _stretches(done, before, after, width)
        if held is not None:
            yield _stretches(held, before, after, width)

    return ordered.mapInArrow(run, STRETCHES)


def _by_values(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most VALUES values, or of one row."""
    upto = np.cumsum(np.nan_to_num(batch.column("values").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + VALUES, "right")))
        yield batch.slice(at, end - at)
        at = end


class Kept(NamedTuple):
    """What pieces keep of their bin, in order: a row for each, and the values of all; ``new`` rows begin a bin, ``head`` rows a block."""

    chrom: np.ndarray
    bin: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    new: np.ndarray
    head: np.ndarray
    flat: np.ndarray

    def cut(self, row: int) -> tuple[Kept, Kept]:
        k = int(self.sizes[:row].sum())
        return Kept(*(x[:row] for x in self[:-1]), self.flat[:k]), Kept(*(x[row:] for x in self[:-1]), self.flat[k:])


def _kept(batch: pa.RecordBatch, reached: tuple[str, int, int] | None, before: int, after: int) -> tuple[Kept, tuple[str, int, int]]:
    """What earlier pieces of a bin leave of each piece; ``reached`` is the last bin so far and how far its pieces reach."""
    chrom, bin_, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chrom", "bin", "at"))
    sizes, flat = batch.column("values").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("values").flatten().to_numpy(zero_copy_only=False)
    new = np.r_[reached is None or reached[:2] != (chrom[0], bin_[0]), (chrom[1:] != chrom[:-1]) | (bin_[1:] != bin_[:-1])]
    # Places within bins, which are laid end to end: what earlier bins reach is below all of this one.
    low = np.cumsum(new) * (BIN + before + after + 1)
    first = low + at - bin_ * BIN + before
    last = first + sizes
    upto = np.maximum.accumulate(np.r_[-1 if reached is None else reached[2], last])
    own = np.maximum(first, upto[:-1])
    left, skipped = np.maximum(last - own, 0), own - first
    if skipped.any():
        there = left > 0
        to = np.cumsum(left[there]) - left[there]
        flat = flat[np.repeat((np.cumsum(sizes) - sizes + skipped)[there] - to, left[there]) + np.arange(left.sum())]
        # A bin's first piece keeps all it has, so no bin loses its beginning.
        kept = Kept(chrom[there], bin_[there], (at + skipped)[there], left[there], new[there], (upto[:-1] <= first)[there], flat)
    else:
        kept = Kept(chrom, bin_, at, sizes, new, upto[:-1] <= first, flat)
    return kept, (chrom[-1], bin_[-1], int(upto[-1] - low[-1]))


def _stretches(kept: Kept, before: int, after: int, width: int) -> pa.RecordBatch:
    """Runs of whole bins."""
    flat, at, sizes, starts = kept.flat, kept.at, kept.sizes, np.cumsum(kept.sizes) - kept.sizes
    if width:
        flat = _window_sums(np.nan_to_num(flat), starts[kept.head], before, after) / width
        low = kept.bin * BIN
        early, late = np.clip(low - at, 0, sizes), np.clip(at + sizes - low - BIN, 0, sizes)
        there = np.ones(len(flat), bool)
        for i in np.flatnonzero(early + late):
            there[starts[i] : starts[i] + early[i]] = there[starts[i] + sizes[i] - late[i] : starts[i] + sizes[i]] = False
        flat, at, sizes = flat[there], at + early, np.maximum(sizes - early - late, 0)
    # Places of all chromosomes on one line, far apart.
    names = np.cumsum(np.r_[False, kept.chrom[1:] != kept.chrom[:-1]])
    pos = np.arange(len(flat)) + np.repeat(names * FAR + at - (np.cumsum(sizes) - sizes), sizes)
    if (gaps := np.isnan(flat)).any():
        pos, flat = pos[~gaps], flat[~gaps]
    apart = np.r_[True, (pos[1:] != pos[:-1] + 1) | (pos[1:] % BIN == 0)][: len(pos)]
    cut = np.flatnonzero(apart | np.r_[True, flat[1:] != flat[:-1]][: len(pos)])
    heads = np.flatnonzero(apart[cut])
    ends = pa.array(np.r_[heads, len(cut)].astype(np.int32))
    stops = pos[np.r_[cut[1:], len(pos)] - 1] % FAR + 1 if len(pos) else pos
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (stops, flat[cut])]
    first = pos[cut[heads]]
    chrom = kept.chrom[np.r_[True, kept.chrom[1:] != kept.chrom[:-1]]][first // FAR]
    return pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(first % FAR), *lists], names=["chrom", "start", "ends", "values"])


def _window_sums(value: np.ndarray, heads: np.ndarray, before: int, after: int) -> np.ndarray:
    """Sums of ``before`` values, the own and ``after`` values in blocks that begin at ``heads``: zeros stand between blocks, as many as a window reaches."""
    gap, sizes, out = max(before, after), np.diff(np.r_[heads, len(value)]), np.empty(len(value))
    room = np.cumsum(sizes + gap) // VALUES
    for a, b in pairwise(np.r_[np.flatnonzero(np.r_[True, np.diff(room) > 0]), len(heads)].tolist()):
        low, high = heads[a], heads[b] if b < len(heads) else len(value)
        to = np.arange(high - low) + np.repeat(gap * np.arange(1, b - a + 1), sizes[a:b])
        spaced = np.zeros(high - low + gap * (b - a + 1))
        spaced[to] = value[low:high]
        sums, n = spaced[gap : len(spaced) - gap].copy(), len(spaced) - 2 * gap
        for d in (d for d in range(-before, after + 1) if d):
            sums += spaced[gap + d : gap + d + n]
        out[low:high] = sums[to - gap]
    return out


def _rows(stretches: DataFrame) -> DataFrame:
    """``chrom, start, stop, value`` of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _by_values(b)):
            row, starts, stops, values = flat_stretches(batch)
            yield pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(row)), pa.array(starts), pa.array(stops), pa.array(values)], names=["chrom", "start", "stop", "value"])

    return stretches.mapInArrow(run, BEDGRAPH)


def value_runs(pieces: DataFrame) -> DataFrame:
    """``chrom, start, stop, value`` of pieces: a row for each run of equal values, not for each base; nulls are gaps."""
    return _rows(signal_stretches(pieces))
