"""Signal in bigWig files and sequences in FASTA files, by ranges."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.sources import bigwig as B
from larkspur.sources import files
from larkspur.sources.storage import place


def intervals(n, seed=1, chroms=("chr1", "chr10", "chr2")):
    rng, rows = np.random.default_rng(seed), []
    for c in chroms:
        ends = np.cumsum(rng.integers(1, 60, 2 * n))
        rows += [(c, int(a), int(b), float(np.float32(v))) for a, b, v in zip(ends[::2], ends[1::2], rng.normal(size=n))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, stop long, value double")


def opened(path):
    [name] = B.files_of(path)
    return B.Track(place(name)[0].open_input_file(place(name)[1]), name)


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """300,000 intervals in one file: 294 blocks, so the tree has two levels."""
    path, rows = str(tmp_path_factory.mktemp("bw") / "one"), intervals(100_000)
    sizes = spark.createDataFrame([("chr1", 1 << 24), ("chr2", 1 << 25), ("chr3", 5)], "chrom string, length long")
    B.write_bigwig(frame(spark, rows), path, sizes, files=1)
    return path, rows


def test_round_trip_in_one_file_and_in_many(spark, one_file, tmp_path):
    path, rows = one_file
    assert sorted(tuple(r) for r in B.read_bigwig(spark, path).collect()) == sorted(rows)
    assert opened(path).names == {0: ("chr1", 1 << 24), 1: ("chr10", max(r[2] for r in rows if r[0] == "chr10")), 2: ("chr2", 1 << 25)}
    few = intervals(500, 2) + [(None, 1, 2, 3.0), ("chr1", None, 2, 3.0), ("chr1", 1, 2, None)]
    B.write_bigwig(frame(spark, few).repartition(3), str(tmp_path / "many"), files=5)
    assert len(B.files_of(str(tmp_path / "many"))) == 5
    assert sorted(tuple(r) for r in B.read_bigwig(spark, str(tmp_path / "many")).collect()) == sorted(few[:-3])
    B.write_bigwig(frame(spark, few[:7]), str(tmp_path / "many"), files=1)  # written over
    assert B.read_bigwig(spark, str(tmp_path / "many")).count() == 7
    B.write_bigwig(frame(spark, []), str(tmp_path / "none"))
    assert B.read_bigwig(spark, str(tmp_path / "none")).count() == 0


def test_filters_read_fewer_blocks(spark, one_file):
    path, rows = one_file
    everything = len(list(opened(path).blocks([opened(path).root], B.Bounds())))
    where = "chrom = 'chr10' AND start < 2000000 AND stop > 1990000"
    [low, high] = [1_990_000, 2_000_000]
    got = B.read_bigwig(spark, path).filter(where)
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in rows if r[0] == "chr10" and r[1] < high and r[2] > low)
    bounds = B.bounds_of([B.EqualTo(("chrom",), "chr10"), B.LessThan(("start",), high), B.GreaterThan(("stop",), low)])
    track = opened(path)
    before = track.read_bytes
    blocks = list(track.blocks(track.nodes(bounds, 1_000), bounds))
    list(track.intervals(blocks))
    assert everything > 290 and len(blocks) <= 2 and track.read_bytes - before < 60_000
    assert B.read_bigwig(spark, path, 1).rdd.getNumPartitions() == 1 and B.read_bigwig(spark, path).rdd.getNumPartitions() == 2
    assert B.read_bigwig(spark, path).filter("chrom = 'chr1'").rdd.getNumPartitions() == 1
    for where, keep in (("chrom IN ('chr1', 'x')", lambda r: r[0] == "chr1"), ("start = 77", lambda r: r[1] == 77), ("stop >= 3000 AND stop <= 3100", lambda r: 3000 <= r[2] <= 3100), ("value > 3", lambda r: r[3] > 3), ("chrom = 'none'", lambda r: False)):
        assert sorted(tuple(r) for r in B.read_bigwig(spark, path).filter(where).collect()) == sorted(filter(keep, rows))


def test_summaries(one_file):
    """Every level adds up to the whole file, and the total summary too."""
    path, rows = one_file
    track = opened(path)
    head = struct.unpack("<" + B.HEADER, track._at(0, 64))
    bases, total = sum(b - a for _, a, b, _ in rows), sum((b - a) * v for _, a, b, v in rows)
    n, low, high, s, q = struct.unpack("<" + B.SUMMARY, track._at(head[9], 40))
    assert n == bases and low == min(r[3] for r in rows) and high == max(r[3] for r in rows) and np.isclose(s, total) and np.isclose(q, sum((b - a) * v * v for _, a, b, v in rows))
    zooms = list(struct.iter_unpack("<" + B.ZOOM, track._at(64, 24 * head[2])))
    assert [z[0] for z in zooms] == [1_024 * 4**i for i in range(len(zooms))] and len(zooms) >= 3
    import zlib

    for _, _, start, index in zooms:
        track.index_at, track.root = index, index + 48
        records = np.concatenate([np.frombuffer(zlib.decompress(track._at(*b)), B.RECORD) for b in track.blocks([track.root], B.Bounds())])
        assert struct.unpack("<I", track._at(start, 4))[0] == len(list(track.blocks([track.root], B.Bounds())))
        assert records["covered"].sum() == bases and np.isclose(records["sum"].astype(float).sum(), total, atol=1)


def test_other_layouts(tmp_path):
    """Big-endian files, and blocks of variable and of fixed steps, packed or not."""
    def written(order, packed):
        names = struct.pack(order + B.NAMES_HEADER, B.NAMES_MARK, 256, 2, 8, 1, 0) + struct.pack(order + B.NODE, 1, 0, 1) + b"c\0" + struct.pack(order + "II", 0, 99)
        sections = [struct.pack(order + B.SECTION, 0, 5, 30, 0, 4, B.VARIABLE, 0, 2) + struct.pack(order + "IfIf", 5, 1.5, 20, 2.5), struct.pack(order + B.SECTION, 0, 40, 60, 10, 3, B.FIXED, 0, 2) + struct.pack(order + "ff", 3.5, 4.5)]
        import zlib

        sections = [zlib.compress(s) if packed else s for s in sections]
        data_at = 64 + len(names)
        index_at = data_at + 8 + sum(map(len, sections))
        index = struct.pack(order + B.PLACES_HEADER, B.PLACES_MARK, 256, 2, 0, 5, 0, 60, index_at, 1, 0) + struct.pack(order + B.NODE, 1, 0, 2)
        at = data_at + 8
        for s, (a, b) in zip(sections, ((5, 30), (40, 60))):
            index += struct.pack(order + B.LEAF, 0, a, 0, b, at, len(s))
            at += len(s)
        head = struct.pack(order + B.HEADER, B.MARK, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 1024 * packed, 0)
        return head + names + struct.pack(order + "Q", 2) + b"".join(sections) + index

    for order in "<>":
        for packed in (False, True):
            (tmp_path / "x.bw").write_bytes(written(order, packed))
            track = opened(str(tmp_path / "x.bw"))
            got = [(track.names[c][0], int(a), int(b), float(v)) for c, s, e, x in track.intervals(track.blocks([track.root], B.Bounds())) for a, b, v in zip(s, e, x)]
            assert got == [("c", 5, 9, 1.5), ("c", 20, 24, 2.5), ("c", 40, 43, 3.5), ("c", 50, 53, 4.5)]
    (tmp_path / "x.bw").write_bytes(b"nothing of the kind" * 9)
    with pytest.raises(ValueError, match="no bigWig"):
        opened(str(tmp_path / "x.bw"))


def test_wrong_intervals_are_errors(spark, tmp_path):
    for rows in ([("c", 1, 5, 1.0), ("c", 4, 6, 1.0)], [("c", 3, 3, 1.0)], [("c", 1, 1 << 32, 1.0)], [("c", -4, 2, 1.0)]):
        with pytest.raises(Exception, match="overlap, are empty"):
            B.write_bigwig(frame(spark, rows), str(tmp_path / "bad"), files=1)
        assert not B.files_of(str(tmp_path / "bad"))


def test_tracks_of_regions(spark, one_file):
    path, rows = one_file
    rng = np.random.default_rng(8)
    regions = [(i, ["chr1", "chr2", "x"][i % 3], int(a), int(a) + int(n)) for i, (a, n) in enumerate(zip(rng.integers(0, 6_000_000, 60), rng.integers(1, 900, 60)))]
    given = spark.createDataFrame([*regions, (70, "chr1", -3, 5), (71, "chr1", 9, 9), (72, None, 1, 2)], "k long, chrom string, start long, stop long")
    got = {r.k: r.track for r in B.tracks(given, path).collect()}
    for k, chrom, a, b in regions:
        want = np.zeros(b - a)
        for c, s, e, v in rows:
            if c == chrom and s < b and e > a:
                want[max(s, a) - a : min(e, b) - a] = v
        assert got.pop(k) == want.tolist()
    assert not got


@pytest.mark.parametrize("kind", ["bedgraph", "bigwig"])
@pytest.mark.parametrize("width", [4, 10, 1])
def test_signal_writer(spark, tmp_path, kind, width):
    """Overlaps, regions within others, blocks that only touch, and pieces shorter than the window; per base by brute force."""
    rng, rows, at = np.random.default_rng(5), [], 0
    for i in range(60):
        at += int(rng.integers(0, 14)) if i % 5 else 12
        rows.append((i, "cd"[i // 40], at, at + int(rng.integers(1, 12))))
    rows = [(i, c, a, b, rng.integers(0, 3, b - a + 2 * (i % 4 == 1)).astype(float).tolist()) for i, c, a, b in rows] + [(99, "c", 0, 2, [3.0] * 8), (98, "d", 5, 6, [4.0] * 2)]
    regions = spark.createDataFrame(rows, "region_id long, chrom string, start long, stop long, x array<double>")
    values, block_of, reach = {}, {}, {}
    wide = [(c, a - (len(x) - (b - a)) // 2, i, x) for i, c, a, b, x in rows if (len(x) - b + a) % 2 == 0]
    for c, a, i, x in sorted(w for w in wide if w[1] >= 0):
        if a >= reach.get(c, (0, 0))[0]:
            reach[c] = (a, a)
        reach[c] = (max(reach[c][0], a + len(x)), reach[c][1])
        for k, v in enumerate(x):
            if (c, a + k) not in values:
                values[c, a + k], block_of[c, a + k] = v, reach[c][1]
    path = str(tmp_path / "out")
    for smooth in (False, True):
        files.write_signal(regions, "x", path, smooth, width, kind)
        read = B.read_bigwig(spark, path) if kind == "bigwig" else files.read_tsv(spark, path, files.BEDGRAPH)
        got = read.collect()
        each = {(r.chrom, p): r.value for r in got for p in range(r.start, r.stop)}
        want = values if not smooth else {(c, p): sum(values[c, q] for q in range(p - width // 2, p + width - width // 2) if block_of.get((c, q)) == block_of[c, p]) / width for c, p in values}
        assert each.keys() == want.keys() and all(abs(each[k] - want[k]) < 1e-6 for k in want)
        assert smooth or len(got) < len(values)  # runs of equal values are one row
    with pytest.raises(ValueError):
        files.write_signal(regions, "x", path, kind="wig")


def fasta(chroms, width=60, end="\n"):
    text, index = "", []
    for name, seq in chroms.items():
        text += f">{name} about{end}"
        index.append((name, len(seq), len(text), min(width, len(seq)) or 0, (min(width, len(seq)) + len(end)) if seq else 0))
        text += "".join(seq[i : i + width] + end for i in range(0, len(seq), width))
    return text, index


def test_fasta_index_and_regions(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    one = {name: "".join(rng.choice(list("acgtN"), n)) for name, n in (("c1", 905), ("c2", 60), ("c3", 7), ("empty", 0), ("c4", 240))}
    two = {"d1": "".join(rng.choice(list("ACGT"), 5000))}
    texts = [fasta(one), fasta(two, 70, "\r\n")]
    (tmp_path / "g").mkdir()
    for name, (text, _) in zip(("a.fa", "b.fa"), texts):
        (tmp_path / "g" / name).write_bytes(text.encode())
    records = files.index_fasta(spark, str(tmp_path / "g"))
    assert sorted(tuple(r)[1:] for r in records.collect()) == sorted(texts[0][1] + texts[1][1])
    for size in (7, 64, 1000):
        monkeypatch.setattr(files, "READ_BYTES", size)
        got = [tuple(r[c] for c in ("chrom", "length", "offset", "line_bases", "line_width")) for r in files.fasta_records(str(tmp_path / "g" / "a.fa"))]
        assert got == texts[0][1]
    monkeypatch.undo()
    wanted = [(c, a, b, s) for c, n in (("c1", 905), ("c4", 240), ("d1", 5000)) for a, b, s in zip(rng.integers(0, n // 2, 20).tolist(), rng.integers(n // 2, n + 1, 20).tolist(), "+-" * 10)]
    bad = [("c1", 900, 906, "+"), ("c1", -1, 4, "+"), ("c2", 5, 5, "+"), ("zz", 1, 2, "+"), (None, 1, 2, "+")]
    got = files.read_fasta_regions(spark.createDataFrame(wanted + bad, "chrom string, start long, stop long, strand string"), records).collect()
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert sorted(tuple(r) for r in got) == sorted((c, a, b, s, (x := (one | two)[c][a:b].upper()) if s == "+" else flip((one | two)[c][a:b].upper())) for c, a, b, s in wanted)


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\nACGTA\n", ">a\nACGT\n\nAC\n"])
def test_uneven_lines_are_errors(tmp_path, text):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(ValueError, match="differ in length"):
        list(files.fasta_records(str(tmp_path / "x.fa")))


def test_bytes_read_follow_the_regions(spark, tmp_path, monkeypatch):
    (tmp_path / "g.fa").write_text(fasta({"c": "ACGT" * 250_000})[0])
    [record] = files.fasta_records(str(tmp_path / "g.fa"))
    read, place_ = [], files.place

    class Counted:
        def __init__(self, source):
            self.source = source

        def __getattr__(self, name):
            return getattr(self.source, name)

        def read(self, n):
            read.append(n)
            return self.source.read(n)

    class System:
        def open_input_file(self, inner):
            return Counted(place_(inner)[0].open_input_file(inner))

    monkeypatch.setattr(files, "place", lambda path: (System(), path))
    batch = __import__("pyarrow").RecordBatch.from_pylist([{"file": str(tmp_path / "g.fa"), "from__": a, "to__": a + 100} for a in (10, 80, 500_000, 900_000)])
    seqs = [s for out in files.range_batches(iter([batch])) for s in out.column("seq").to_pylist()]
    assert len(seqs) == 4 and read == [170, 100, 100] and record["length"] == 1_000_000


def test_intervals_of_every_length_meet(spark, monkeypatch):
    """Regions from one base to a whole chromosome make two rows at most, and meet points and intervals by brute force."""
    from larkspur.operators import intervals as I

    monkeypatch.setattr(I, "BIN", 4)
    rng = np.random.default_rng(6)
    sizes = [1, 2, 3, 4, 5, 8, 31, 32, 33, 255, 256, 257, 2_047, 2_048, 2_049, 4_000]
    regions = [(i, "ab"[i % 2], int(a), int(a) + n) for i, (n, a) in enumerate(zip(sizes * 6, rng.integers(0, 2_000, 96)))] + [(200, "a", 5, 5), (201, "c", 0, 9), (202, "a", 0, 6_000)]
    points = [("ab"[i % 2], int(p), float(i)) for i, p in enumerate(rng.integers(0, 6_200, 300))]
    left = spark.createDataFrame(regions, "region_id long, chrom string, start long, stop long")
    own = I._own_bins(left.filter("start < stop").withColumn("level", I.level_of(F.col("stop") - F.col("start"))), "start", "stop", "level")
    assert own.groupBy("region_id").count().agg(F.max("count")).first()[0] == 2
    got = I.range_join(left, spark.createDataFrame(points, "chrom string, pos long, value double"))
    assert sorted((r.region_id, r.pos, r.value) for r in got.collect()) == sorted((i, p, v) for i, c, a, b in regions for d, p, v in points if c == d and a <= p < b)
    signal, at = [], {"a": 0, "b": 0}
    for n in rng.permutation(sizes * 2).tolist():
        for c in "ab":
            at[c] += int(rng.integers(0, 9))
            signal.append((c, at[c], at[c] + n, float(rng.integers(1, 9))))
            at[c] += n
    tracks = {r.region_id: r.track for r in I.track_values(left, spark.createDataFrame(signal, "chrom string, start long, stop long, value double")).collect()}
    base = {c: np.zeros(40_000) for c in "abc"}
    for c, a, b, v in signal:
        base[c][a:b] = v
    assert tracks == {i: base[c][a:b].tolist() for i, c, a, b in regions if a < b}


def test_running_sums_over_ranges(spark):
    from larkspur.operators import relational as R

    rows = [(k, t, (k * 7 + t) % 11) for k in range(60) for t in range(3)]
    got = {(r.k, r.t): r.upto for r in R.running_sum(spark.createDataFrame(rows, "k long, t long, v long").repartition(5), "k", "v", "t").collect()}
    assert got == dict(zip([r[:2] for r in rows], np.cumsum([r[2] for r in rows]).tolist()))
    assert R.running_sum(spark.createDataFrame([], "k long, v long"), "k", "v").count() == 0


def test_only_files_with_regions_are_opened(spark, tmp_path):
    """Of many files, a batch of regions opens those that hold them, and its tracks are right across their borders."""
    import pyarrow as pa

    rows, path = intervals(4_000, 3), str(tmp_path / "many")
    B.write_bigwig(frame(spark, rows), path, files=12)
    given = [(name, B._extents(name)) for name in B.files_of(path)]
    last = {c: max(r[2] for r in rows if r[0] == c) for c in ("chr1", "chr10", "chr2")}
    for regions, most in (([("chr10", a, a + 50) for a in range(100, 5_000, 70)], 2), ([("chr2", 0, last["chr2"])], 6), ([("chr3", 0, 9)], 0)):
        opened = {}
        columns = [pa.array([r[i] for r in regions]) for i in range(3)]
        got = B._tracks(pa.RecordBatch.from_arrays(columns, names=["chrom", "start", "stop"]), given, opened).to_pylist()
        assert len(given) == 12 and len(opened) <= most
        base = {c: np.zeros(max(last.get(c, 9), 6_000)) for c, _, _ in regions}
        for c, a, b, v in rows:
            if c in base:
                base[c][a:b] = v
        assert got == [base[c][a:b].tolist() for c, a, b in regions]


@pytest.mark.parametrize("smooth", [False, True])
def test_signal_across_bins(spark, tmp_path, smooth):
    """Long arrays and short ones beside the borders of bins by brute force; blocks of even steps take few bytes a base."""
    rng = np.random.default_rng(4)
    places = [(1, 40_000, 170_000), (2, 65_530, 65_540), (3, 169_990, 196_606), (4, 196_606, 196_609), (5, 196_609, 196_700), (5, 262_140, 262_150), (5, 262_140, 262_150)]
    rows = [(i, "c", a, b, rng.integers(0, 5, b - a).astype(float).tolist()) for i, a, b in places]
    rows[-1] = rows[-2]  # the same region twice
    path = str(tmp_path / "bw")
    files.write_signal(spark.createDataFrame(rows, "region_id long, chrom string, start long, stop long, x array<double>"), "x", path, smooth, kind="bigwig")
    values, block = np.full(262_200, np.nan), np.zeros(262_200, int)
    for k, (_, _, a, b, x) in enumerate(rows):
        free = np.isnan(values[a:b])
        values[a:b][free] = np.array(x)[free]
        block[a:b][free] = [1, 1, 1, 4, 5, 6, 6][k]
    want = values.copy()
    if smooth:
        for p in np.flatnonzero(~np.isnan(values)):
            near = slice(p - 5, p + 5)
            want[p] = values[near][block[near] == block[p]].sum() / 10
    got = np.full(262_200, np.nan)
    for r in B.read_bigwig(spark, path).collect():
        assert np.isnan(got[r.start : r.stop]).all()
        got[r.start : r.stop] = r.value
    assert np.array_equal(got, want.astype(np.float32).astype(float), equal_nan=True)


def test_even_steps_without_places(tmp_path):
    """Blocks of even steps hold values only; others keep their places, and both are read back."""
    track, rng = B.TrackFile(), np.random.default_rng(2)
    ends = np.cumsum(np.r_[np.full(5_000, 1), np.full(300, 5), rng.integers(1, 9, 700), np.full(4_000, 1)])
    starts, values = np.r_[0, ends[:-1]], rng.normal(size=len(ends)).astype(np.float32)
    track.add("c", starts, ends, values)
    with open(tmp_path / "x.bw", "wb") as sink:
        track.finish(sink)
    read = opened(str(tmp_path / "x.bw"))
    got = [np.concatenate(x) for x in list(zip(*read.intervals(read.blocks([read.root], B.Bounds()))))[1:]]
    assert all(np.array_equal(a, b) for a, b in zip(got, (starts, ends, values)))
    assert sum(size for _, size in read.blocks([read.root], B.Bounds())) < 5 * len(ends)


def test_short_regions_meet_few_neighbours(spark):
    """Bins of a join are about as long as short regions, so that not all of a stretch of 65,536 positions meet."""
    from larkspur.operators import intervals as I

    regions = spark.range(600).selectExpr("id", "id * 100 AS start", "id * 100 + 90 AS stop").withColumn("level", I.level_of(F.col("stop") - F.col("start")))
    shared = I._own_bins(regions, "start", "stop", "level").groupBy("bin").count().agg(F.max("count")).first()[0]
    assert shared <= 13


def test_arrays_of_signal_are_moved_once(spark, tmp_path):
    """However small the regions' table looks, arrays meet no join, which could gather them on the driver, and one shuffle."""
    path = str(tmp_path / "regions")
    spark.createDataFrame([(1, "c", 0, 4, [1.0] * 4)], "region_id long, chrom string, start long, stop long, x array<double>").write.parquet(path)
    for width in (0, 10):
        plan = files.signal_stretches(files.signal_pieces(spark.read.parquet(path), "x"), width)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Repartition") == 1


def test_first_piece_wins_over_slices(monkeypatch):
    """What pieces keep doesn't depend on where batches are cut, and sums of windows not on how many blocks are summed at once."""
    rng = np.random.default_rng(8)
    places = sorted((int(a), int(n)) for a, n in zip(rng.integers(0, 900, 200), rng.choice([1, 3, 60], 200)))
    arrays = [rng.integers(0, 9, n).astype(float).tolist() for _, n in places]
    chroms, at = ["c"] * 150 + ["d"] * 50, [a for a, _ in places]
    batch = pa.RecordBatch.from_arrays([pa.array(chroms), pa.array([0] * 200), pa.array(at), pa.array(arrays, pa.list_(pa.float64()))], names=["chrom", "bin", "at", "values"])
    want, block, reach = {}, {}, {}
    for c, a, x in zip(chroms, at, arrays):
        if a >= reach.get(c, (0, 0))[0]:
            reach[c] = (a, a)
        reach[c] = (max(reach[c][0], a + len(x)), reach[c][1])
        for k, v in enumerate(x):
            if (c, a + k) not in want:
                want[c, a + k], block[c, a + k] = v, reach[c][1]
    sums = {(c, p): sum(want[c, q] for q in range(p - 5, p + 5) if block.get((c, q)) == block[c, p]) for c, p in want}
    for step in (1, 7, 200):
        reached, parts = None, []
        for i in range(0, 200, step):
            own, reached = files._kept(batch.slice(i, step), reached, 5, 4)
            parts.append(own)
        kept = files.Kept(*map(np.concatenate, zip(*parts)))
        keys = [(c, a + k) for c, a, n in zip(kept.chrom, kept.at, kept.sizes) for k in range(n)]
        assert dict(zip(keys, kept.flat)) == want and len(keys) == len(want)
        for most in (1 << 19, 20):
            monkeypatch.setattr(files, "VALUES", most)
            assert dict(zip(keys, files._window_sums(kept.flat, (np.cumsum(kept.sizes) - kept.sizes)[kept.head], 5, 4))) == sums
