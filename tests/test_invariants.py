"""What must hold of operators that SQL can't express."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.operators import attribution as A
from larkspur.operators import classifiers as C
from larkspur.operators import intervals as I
from larkspur.operators import motifs as M
from larkspur.operators import pca
from larkspur.operators import sequences as S
from larkspur.operators.concepts import ConceptBuilder
from larkspur.plans import linear_queries as Q
from larkspur.plans import proxies as P
from larkspur.plans.report import page
from larkspur.sources import files
from larkspur.streaming.scoring import sign_stream

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rows = Q._vectors(spark, SF)
    return rows, np.array([r.vector for r in rows.orderBy("id").collect()], float)


def test_components(spark):
    rows, x = vectors(spark)
    model = pca.fit(rows)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(model.variances, np.linalg.svd(z, compute_uv=False) ** 2 / (len(x) - 1))
    assert np.allclose(model.components @ model.components.T, np.eye(64)) and np.isclose(model.variances.sum(), 64)
    few = pca.fit(rows, 8)
    p, r = pca.project(x, few)
    assert np.allclose(p @ few.components + r, z) and np.allclose(r @ few.components.T, 0, atol=1e-9)
    assert np.allclose(pca.restore(np.concatenate([p, r], axis=1), few), x)
    got = np.array([e.emb for e in pca.embed(rows, few).orderBy("id").collect()])
    assert np.allclose(got, np.concatenate([p, r], axis=1))
    flat = pca.fit(rows.withColumn("vector", F.concat(F.array(F.lit(1.0).cast("float")), F.slice("vector", 2, 63))), 3)
    assert flat.std[0] == -1 and np.isclose(flat.variances.sum(), 63)


def test_attributions_add_up(spark):
    rows, x = vectors(spark)
    layers, base = Q.network(), x[:1]
    m = A.multipliers(x, np.repeat(base, len(x), axis=0), layers)
    assert np.allclose((m * (x - base)).sum(axis=1), (A.forward(x, layers)[-1] - A.forward(base, layers)[-1])[:, 0])
    model = pca.fit(rows, 8)
    pairs = rows.withColumn("base", F.array(*map(F.lit, base[0].tolist())))
    signed = np.array([r.a for r in A.layer_attributions(pairs, layers, model, absolute=False).orderBy("id").collect()])
    assert np.allclose(signed.sum(axis=1), (m * (x - base)).sum(axis=1))
    basis = pca.subspace(np.random.default_rng(0).normal(size=(3, signed.shape[1])))
    inside, outside = A.split_by_subspace(signed, basis)
    assert np.allclose(inside + outside, signed) and np.allclose(outside @ basis, 0, atol=1e-8)
    assert pca.subspace(np.array([[1.0, 0, 0], [2.0, 0, 0]])).shape == (3, 1)
    out = A.layer_output(rows, layers, 2).orderBy("id").collect()
    assert np.allclose([r.vector for r in out], A.forward(x, layers)[2])


def test_classifiers_find_separable_concepts(spark):
    rng = np.random.default_rng(3)
    data = [(i, "a" if i % 3 == 1 else "b" if i % 3 == 2 else "0", (rng.normal(size=5) + (np.eye(5)[i % 3] * 6)).tolist()) for i in range(300)]
    rows = spark.createDataFrame(data, "id long, concept string, emb array<double>")
    samples = C.samples_for(rows, "0", 80)
    assert {(r.concept, r.truth, r.split): r["count"] for r in samples.groupBy("concept", "truth", "split").count().collect()} == {(c, t, s): n for c in "ab" for t in (0, 1) for s, n in (("test", 8), ("train", 72))}
    got = {r.concept: r for r in C.train(samples).collect()}
    assert set(got) == {"a", "b"} and all(r.fscore > 0.9 and r.accuracy > 0.9 for r in got.values())
    w = np.array(got["a"].w)
    assert w[1] > 0 > w[0]  # towards the concept, away from the control


def test_order_of_clusters():
    order = pca.average_linkage_order(np.array([[1, 0.1, 0.9], [0.1, 1, 0.2], [0.9, 0.2, 1]]))
    assert sorted(order) == [0, 1, 2] and abs(order.index(0) - order.index(2)) == 1


def test_insertions(spark):
    matrix = np.eye(4)[[0, 1, 2, 3, 3, 2]]
    rows = spark.createDataFrame([(i, "T" * 80) for i in range(40)] + [(99, "TTT"), (98, None)], "seq_id long, seq string")
    once, again = ({r.seq_id: r for r in S.with_motifs(d, matrix, 4, 5, 7).collect()} for d in (rows, rows.repartition(5)))
    assert once == again
    for i, r in once.items():
        if i < 90:
            assert len(r.places) == 4 and min(r.places) >= 5 and max(r.places) + 6 <= 80 - 7
            assert all(r.seq[p : p + 6] == "ACGTTG" for p in r.places) and np.diff(sorted(r.places)).min() >= 6
    assert once[99].seq == "TTT" and once[98].places == []


def test_dinucleotides_are_kept(spark):
    seqs = {r.seq_id: r.seq for r in P.sequences(spark, SF).collect()}
    pairs = lambda s: Counter(zip(s, s[1:]))
    moved = 0
    for r in S.with_shuffles(P.sequences(spark, SF), 2).collect():
        own = seqs[r.seq_id]
        assert pairs(r.seq) == pairs(own) and r.seq[:1] == own[:1] and r.seq[-1:] == own[-1:]
        moved += r.seq != own
    assert moved > 100


def test_pwm_sampling_and_gc(spark):
    fixed = spark.createDataFrame([("m", i + 1, *map(float, row)) for i, row in enumerate(np.eye(4))], "motif string, pos int, a double, c double, g double, t double")
    assert {r.seq for r in M.sampled(fixed, 20, "1").collect()} == {"ACGT"}
    even = spark.createDataFrame([("m", 1, 0.25, 0.25, 0.25, 0.25)], fixed.schema)
    share = Counter(r.seq for r in M.sampled(even, 10_000, "1").collect())
    assert all(abs(share[b] / 10_000 - 0.25) < 0.02 for b in "ACGT")
    assert [r.seq for r in M.sampled(even, 9, "1").orderBy("draw").collect()] != [r.seq for r in M.sampled(even, 9, "2").orderBy("draw").collect()]
    for gc in (0.0, 0.3, 1.0):
        text = "".join(r.seq for r in S.synthetic_gc(spark.range(50).selectExpr("id AS seq_id", "200 AS length"), gc, "1").collect())
        assert abs((text.count("G") + text.count("C")) / len(text) - gc) < 0.05
    assert S.gc_grid(0.1) == [min(1.0, i * 0.1) for i in range(11)]


def test_pssm_hits(spark):
    motif = spark.createDataFrame([("m", i + 1, *(0.97 if j == i else 0.01 for j in range(4))) for i in range(4)], "motif string, pos int, a double, c double, g double, t double")
    rows = spark.createDataFrame([(1, "TTACGTTTACGT"), (2, "TTTT"), (3, "AC"), (4, "")], "seq_id long, seq string")
    assert {r.seq_id: r.hits for r in M.pssm_hits(rows, motif, 6.0).collect()} == {1: 4, 2: 0, 3: 0, 4: 0}  # ACGT is its own reverse complement


def test_permuted_motifs(spark):
    rows = spark.createDataFrame([("a", "ACGTTGCA"), ("b", "AC")], "motif string, consensus string")
    for r in M.permuted(rows, 0.3, "1").collect():
        assert sorted(r.permuted) == sorted(r.consensus) and r.moved >= 0.3


def test_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\nACGTACGTAC\nGTNN\n>chr2\nttttaaaa\n")
    genome = files.read_fasta(spark, str(tmp_path / "g.fa"), 5)
    assert {(r.chrom, r.chunk_start): r.seq for r in genome.collect()} == {("chr1", 0): "ACGTA", ("chr1", 5): "CGTAC", ("chr1", 10): "GTNN", ("chr2", 0): "TTTTA", ("chr2", 5): "AAA"}
    (tmp_path / "r.bed").write_text("# c\nchr1\t3\t9\t+\tx\nchr2\t0\t6\t-\ty\nchr9\t0\t5\t+\tz\nchr1\t12\t20\t+\tz\n")
    regions = files.read_tsv(spark, str(tmp_path / "r.bed"), files.BED5)
    assert {r.concept: r.seq for r in S.region_sequences(regions, genome).collect()} == {"x": "TACGTA", "y": "TTAAAA"}
    meme = "MEME version 4\n\nALPHABET= ACGT\n\nMOTIF M/1:x alt\nletter-probability matrix: alength= 4 w= 2 nsites= 20 E= 0\n 0.5 0.5 0 0\n0.25\t0.25 0.25 0.25\n\nMOTIF b\nletter-probability matrix: alength= 4 w= 1 nsites= 20 E= 0\n1 0 0 0\n"
    (tmp_path / "m.meme").write_text(meme)
    got = files.read_meme(spark, str(tmp_path / "m.meme"))
    assert sorted((r.motif, r.pos, r.a, r.t) for r in got.collect()) == [("M/1:x", 1, 0.5, 0.0), ("M/1:x", 2, 0.25, 0.25), ("b", 1, 1.0, 0.0)]
    both = files.read_meme_files(spark, [str(tmp_path / "m.meme")] * 3)
    assert {r.motif for r in both.collect()} == {"M/1:x", "M/1:x_1", "M/1:x_2", "b", "b_1", "b_2"}
    files.write_meme(got, str(tmp_path / "out"))
    assert sorted(files.read_meme(spark, str(tmp_path / "out")).collect()) == sorted(got.collect())
    (tmp_path / "a_control_c1").mkdir()
    (tmp_path / "a_control_c1" / "p.tsv").write_text("# note\nPred\tTruth\n1\t0\n1\t1\n")
    assert [tuple(r) for r in files.read_prediction_folders(spark, str(tmp_path / "*_control_*")).collect()] == [("a", "c1", 1, 0), ("a", "c1", 1, 1)]


def test_signal_of_overlapping_regions(spark):
    rows = [(1, "c", 4, 8, [1.0] * 4), (2, "c", 6, 10, [2.0] * 6), (3, "c", 0, 2, [3.0] * 6), (4, "d", 5, 6, [4.0] * 2)]
    regions = spark.createDataFrame(rows, "region_id long, chrom string, start long, stop long, x array<double>")
    got = {(r.chrom, p): r.value for r in files.value_runs(files.signal_pieces(regions, "x")).collect() for p in range(r.start, r.stop)}
    assert got == {("c", p): 1.0 if p < 8 else 2.0 for p in range(4, 11)}  # region 3 would begin before 0, region 4 has an odd surplus


def test_wide_and_nested_intervals(spark, monkeypatch):
    monkeypatch.setattr(I, "BIN", 64)  # regions across many bins
    rng = np.random.default_rng(2)
    rows = [(i, "c", int(a), int(a) + int(n)) for i, (a, n) in enumerate(zip(rng.integers(0, 5000, 120), rng.integers(1, 300, 120)))]
    regions = spark.createDataFrame(rows, "region_id long, chrom string, start long, stop long")
    owner = {}
    for i, _, a, b in sorted(rows, key=lambda r: (r[2], r[0])):
        for p in range(a, b):
            owner.setdefault(p, i)
    got = {p: r.region_id for r in I.first_wins(regions, "region_id").collect() for p in range(r.start, r.stop)}
    assert got == owner
    blocks, end = [], -1
    for _, _, a, b in sorted(rows, key=lambda r: (r[2], r[0])):
        if a >= end:
            blocks.append([a, b, 0])
        blocks[-1][1], blocks[-1][2] = max(blocks[-1][1], b), blocks[-1][2] + 1
        end = blocks[-1][1]
    assert sorted([r.start, r.stop, r.n] for r in I.merge_overlaps(regions, "region_id").collect()) == blocks


def test_insertions_by_batch():
    """The same places whatever stands beside a sequence; every free place is as likely, also after others are taken."""
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 60, 300)]
    variants = [np.cumsum(np.eye(4)[[0, 1, 2]], axis=1), np.cumsum(np.eye(4)[[3, 3, 3, 3, 3]], axis=1)]
    keys = np.arange(300) * 7 - 90
    made, places = S.inserted(S.Letters.of(pa.array(seqs)), keys, variants, 4, 2, 3, 5)
    texts = made.strings().to_pylist()
    part, own = S.inserted(S.Letters.of(pa.array(seqs[100:130])), keys[100:130], variants, 4, 2, 3, 5)
    assert part.strings().to_pylist() == texts[100:130] and (own == places[100:130]).all()
    for seq, text, at in zip(seqs, texts, places.tolist()):
        at = [p for p in at if p >= 0]
        if not at:
            assert text == seq and len(seq) <= 10
            continue
        motif = next(m for m in ("ACG", "TTTTT") if all(text[p : p + len(m)] == m for p in at))
        assert len(text) == len(seq) and all(2 <= p < len(seq) - len(motif) - 3 for p in at) and all(abs(p - q) >= len(motif) for p in at for q in at if p != q)
        covered = {p + i for p in at for i in range(len(motif))}
        assert all(a == b for i, (a, b) in enumerate(zip(seq, text)) if i not in covered)
        room = [p for p in range(2, len(seq) - len(motif) - 3) if all(abs(p - q) >= len(motif) for q in at)]
        assert len(at) == 4 or not room
    n = 30_000
    _, places = S.inserted(S.Letters.of(pa.array(["A" * 12] * n)), np.arange(n), [np.cumsum(np.eye(4)[[1, 1]], axis=1)], 2, 0, 0, 3)
    first, then = Counter(places[:, 0].tolist()), Counter(map(tuple, places.tolist()))
    assert all(abs(first[p] / n - 0.1) < 0.01 for p in range(10))
    for p in range(10):
        free = [q for q in range(10) if abs(p - q) >= 2]
        assert all(abs(then[p, q] / first[p] - 1 / len(free)) < 0.04 for q in free)


def test_shuffles_are_even_over_all_paths():
    """Every sequence with the same pairs of neighbours is as likely, by enumeration; long walks end where short ones do."""
    import itertools

    def pairs(s):
        return sorted(zip(s, s[1:]))

    for seq in ("AACAGAC", "ABABBA", "CACGTCA"):
        want = {p for x in set(itertools.permutations(seq)) if pairs(p := "".join(x)) == pairs(seq) and p[0] == seq[0]}
        n = 4_000
        letters = S.Letters.of(pa.array([seq] * n))
        got = Counter(S.shuffled(letters, np.arange(n), 1, 0, np.unique(letters.flat)).strings().to_pylist())
        assert set(got) == want and all(abs(c / n - 1 / len(want)) < 5 * (1 / len(want) / n) ** 0.5 for c in got.values())
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.3, 0.3, 0.2, 0.15, 0.05])) for n in [*rng.integers(0, 90, 40), 5_000, 4_000, 1, 2, 3]] + ["A" * 50, "A" * 5_000 + "C", None]
    letters = S.Letters.of(pa.array(seqs))
    for copy in (0, 1):
        made = S.shuffled(letters, np.arange(len(seqs)), 4, copy, np.unique(letters.flat)).strings().to_pylist()
        assert all(pairs(a) == pairs(b or "") and a[:1] == (b or "")[:1] and a[-1:] == (b or "")[-1:] for a, b in zip(made, seqs))
    assert made[40] != seqs[40]
    alone = S.Letters.of(pa.array(seqs[38:42]))
    assert S.shuffled(alone, np.arange(38, 42), 4, 1, np.unique(letters.flat)).strings().to_pylist() == made[38:42]


def test_builder(spark):
    control = spark.createDataFrame([(i, "ACGT" * 10 if i else "ACGN") for i in range(10)], "seq_id long, seq string")
    builder = ConceptBuilder(control, 2, least=3).add_motif("m/1", np.eye(4), permuted=True).add_synthetic_gc(0.5, 4, 20)
    builder.add_sequences(spark.createDataFrame([("x", 1, "AC"), ("x", 2, "AC"), ("x", 3, "AC"), ("y", 1, "AC")], "concept string, seq_id long, seq string"))
    got = {(r.concept, r.role): r.n for r in builder.summary().collect()}
    assert got == {("control", "control"): 9, ("m-1", "test"): 9, ("m-1_permuted", "permuted"): 9, ("x", "test"): 3, **{(f"synthetic_gc_{g}", "test"): 4 for g in ("0.00", "0.50", "1.00")}}
    assert "m-1_permuted" not in {r.concept for r in builder.for_components().select("concept").distinct().collect()}


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), "id", F.array(F.sin("id"), F.cos("id")).alias("a"))
    rows.write.parquet(str(tmp_path / "in"))
    cavs = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.5, -1.0])], "concept string, w array<double>")
    stream = sign_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), cavs)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("signs").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.window.start, r.concept, r.n_pos, r.n_neg)
    assert sorted(map(key, spark.table("signs").collect())) == sorted(map(key, sign_stream(rows, cavs).collect()))


def test_report_escapes(spark):
    text = page("a<b", {"t": spark.createDataFrame([("<script>", 1)], "name string, n int")})
    assert "<script>" not in text and "a&lt;b" in text
