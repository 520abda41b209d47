"""Queries that SQL can't express, run whole and held against NumPy or what must be true of their results."""

import math
import statistics
import time
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur import __main__ as command
from larkspur.operators import attribution as A
from larkspur.operators import classifiers as C
from larkspur.operators import intervals as I
from larkspur.operators import metrics as X
from larkspur.operators import motifs as M
from larkspur.operators import pca
from larkspur.operators import relational as R
from larkspur.operators import sequences as S
from larkspur.operators.concepts import ConceptBuilder
from larkspur.plans import attributions as T
from larkspur.plans import catalogue
from larkspur.plans import linear_queries as Q
from larkspur.plans import proxies as P
from larkspur.plans.report import ROWS, page
from larkspur.plans.run import run_concepts, similarity_order
from larkspur.sources import bigwig, files
from larkspur.sources.storage import discard, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rows = Q._vectors(spark, SF).orderBy("id").collect()
    return [r.id for r in rows], np.array([r.vector for r in rows], float), [r.concept for r in rows]


def ran(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows
    return rows


def test_every_query_without_sql_is_tested():
    here = set(open(__file__).read().split('"'))
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) <= here


def test_variance_and_embeddings(spark, data):
    ids, x, _ = data
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    got = sorted(ran(spark, "i3_pca_variance"))
    assert np.allclose([r.share for r in got], s / s.sum()) and np.isclose(got[-1].upto, 1)
    by = {r.id: r.emb for r in ran(spark, "i5_embeddings")}
    v = np.linalg.svd(z)[2][: Q.COMPONENTS]
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    assert np.allclose([by[i] for i in ids], np.concatenate([z @ v.T, z - z @ v.T @ v], axis=1), atol=1e-6)


def test_network_queries(spark, data):
    ids, x, concept = data
    layers = Q.network()
    by = {r.id: r.vector for r in ran(spark, "j6_layer_output")}
    assert np.allclose([by[i] for i in ids], A.forward(x, layers)[2])
    by = {r.id: r.output for r in ran(spark, "j7_patched_output")}
    assert np.allclose([by[i] for i in ids], A.forward(x, layers)[-1][:, 0])
    base = x[[c == "0" for c in concept]].mean(axis=0)
    by = {r.id: r.a for r in ran(spark, "j8_mlp_attribution")}
    model = pca.fit(Q._vectors(spark, SF), Q.COMPONENTS)
    e, e0 = (np.concatenate(pca.project(v, model), axis=1) for v in (x, base[None]))
    m = A.multipliers(x, np.repeat(base[None], len(x), axis=0), layers) @ (np.concatenate([model.components, np.eye(64)]) * model.std).T
    assert np.allclose([by[i] for i in ids], m * np.abs(e - e0))
    parts = {(r.part, r.id): r.total for r in ran(spark, "j9_input_attributions")}
    change = A.forward(x, layers)[-1][:, 0] - A.forward(np.zeros((1, 64)), layers)[-1][0, 0]
    assert np.allclose([parts["all", i] for i in ids], change)
    assert np.allclose([parts["inside", i] + parts["outside", i] for i in ids], change)
    assert np.abs([parts["inside", i] for i in ids]).max() > 1e-3


def test_classifier_queries(spark):
    concepts = set(map(str, range(1, 10)))
    for name, key, want in (("j1_classifiers", lambda r: (r.penalty, r.concept), {(p, c) for p in ("l1", "l2") for c in concepts}), ("j2_adamw_classifiers", lambda r: r.concept, concepts), ("j5_paired_controls", lambda r: r.concept, concepts | {"0"})):
        rows = ran(spark, name)
        assert len(rows) == len(want) and {key(r) for r in rows} == want
        assert all(0 <= r[m] <= 1 for r in rows for m in ("fscore", "fscore_macro", "accuracy", "train_fscore", "train_accuracy"))
        assert np.mean([r.train_accuracy for r in rows]) > 0.6


def test_direction_queries(spark, data):
    ids, _, _ = data
    order = sorted(ran(spark, "i10_cluster_order"))
    assert [r.place for r in order] == list(range(9)) and {r.concept for r in order} == set(map(str, range(1, 10)))
    shares = {r.id: r.share for r in ran(spark, "i7_cav_subspace")}
    assert set(shares) == set(ids) and all(0 <= v <= 1 + 1e-9 for v in shares.values())
    found = ran(spark, "e19_cluster_similarity")
    assert len(found) == 3 * len(ids) and {r.cluster for r in found} == {0, 1, 2} and all(-1 <= r.mean_cosine <= 1 for r in found)
    run = ran(spark, "k5_concept_run")
    assert {r.concept for r in run} == set(map(str, range(1, 10))) and all(r.n_pos + r.n_neg <= len(ids) for r in run)
    assert all(abs(r.log_ratio - np.log((r.n_pos + 1) / (r.n_neg + 1))) < 1e-5 for r in run)


def test_clusters_of_leaves():
    similarity = np.array([[1, 0.1, 0.9, 0.1], [0.1, 1, 0.2, 0.8], [0.9, 0.2, 1, 0.1], [0.1, 0.8, 0.1, 1]])
    assert pca.clusters(similarity, 2) == [0, 1, 0, 1] and pca.clusters(similarity, 4) == [0, 1, 2, 3] and pca.clusters(similarity, 1) == [0] * 4


def test_sequence_queries(spark):
    seqs = {r.seq_id: r.seq for r in P.sequences(spark, SF).collect()}
    for r in ran(spark, "c3_motif_insertion"):
        places = [int(p) for p in r.places.split(",") if p]
        own = seqs[r.seq_id]
        assert r.n == len(own) and (0 < len(places) <= 3 or len(own) < 13) and all(2 <= p <= len(own) - 10 for p in places)
        assert all(abs(a - b) >= 8 for i, a in enumerate(places) for b in places[:i])
        assert len(own) < 60 or r.seq_md5 != md5(own.encode()).hexdigest()
    again = {(r.seq_id, r["copy"]): r.seq for r in S.with_shuffles(P.sequences(spark, SF).repartition(3), 2).collect()}
    for r in ran(spark, "c8_dinuc_shuffle"):  # of another partitioning; test_invariants has the properties
        assert r.n == len(seqs[r.seq_id]) and r.seq_md5 == md5(again[r.seq_id, r["copy"]].encode()).hexdigest()


def test_pssm_query(spark):
    """Every window one by one, for some sequences."""
    pwm = defaultdict(list)
    for r in P.pwm(spark, SF).orderBy("pos").collect():
        pwm[r.motif].append(np.log2(np.maximum([r.a, r.c, r.g, r.t], 1e-3) / 0.25))
    hits = {(r.seq_id, r.motif): r.hits for r in ran(spark, "c13_pssm_hits")}
    seqs = {r.seq_id: r.seq for r in P.sequences(spark, SF).collect()}
    assert len(hits) == len(seqs) * len(pwm)
    for i in sorted(seqs, key=lambda i: len(seqs[i]))[:60]:
        for motif, m in pwm.items():
            windows = [seqs[i][k : k + len(m)] for k in range(len(seqs[i]) - len(m) + 1)]
            both = windows + [w.translate(str.maketrans("ACGT", "TGCA"))[::-1] for w in windows]
            assert hits[i, motif] == sum(sum(row["ACGT".index(c)] for row, c in zip(m, w)) >= 4.0 for w in both)


def test_motif_run_query(spark):
    rows = ran(spark, "k5_motif_run")
    n = P.sequences(spark, SF).filter("seq <> ''").count()
    assert {(r.insertions, r.concept) for r in rows} == {(n, c) for n in (2, 8) for c in ("de", "en", "es", "fr")}
    assert all(0 <= r.fscore <= 1 and 0 < r.n_pos + r.n_neg <= n and r.log_ratio == pytest.approx(math.log((r.n_pos + 1) / (r.n_neg + 1))) for r in rows)


def test_all_concepts_query(spark):
    """Every kind of concept is there, and those that differ most from the control are told from it."""
    rows = {(r.insertions, r.concept): r for r in ran(spark, "k5_all_concepts")}
    others = {c for n, c in rows if n == 0}
    assert {c.partition("_")[0] for c in others} == {"region", "track", "synthetic"} and {c for n, c in rows if n} == {"M0", "M1", "M2"}
    assert rows[0, "synthetic_gc_0.00"].fscore > 0.9 and rows[0, "synthetic_gc_1.00"].fscore > 0.9
    assert rows[6, "M0"].fscore >= rows[2, "M0"].fscore - 0.15


def sharp_and_flat(spark):
    sharp = np.full((6, 4), 0.01)
    sharp[np.arange(6), [0, 0, 1, 2, 3, 3]] = 0.97
    rows = [("m/1", i + 1, *map(float, r)) for i, r in enumerate(sharp)] + [("flat", i + 1, 0.25, 0.25, 0.25, 0.25) for i in range(6)]
    return spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")


@pytest.mark.parametrize("kind", ["permuted", "random"])
def test_run_finds_planted_motifs(spark, tmp_path, kind):
    """A sharp motif is told from its control, better with more copies; an even one isn't; tables and page are written."""
    rng = np.random.default_rng(0)
    control = spark.createDataFrame([(i, "".join(rng.choice(list("ACGT"), 120))) for i in range(160)], "seq_id long, seq string")
    tables = run_concepts(control, S.kmer_shares, Q.network(), sharp_and_flat(spark), insertions=(8, 1), control_kind=kind, per_concept=120, path=str(tmp_path / "run"))
    scores = {(r.insertions, r.concept): r for r in tables["scores"].collect()}
    assert set(scores) == {(n, c) for n in (1, 8) for c in ("m-1", "flat")}
    assert scores[8, "m-1"].fscore > 0.9 and scores[8, "m-1"].fscore > scores[8, "flat"].fscore and scores[8, "m-1"].fscore >= scores[1, "m-1"].fscore
    read = files.read_run(spark, str(tmp_path / "run"), ["areas", "trends", "similarity"])
    areas = read["areas"].collect()
    assert [r.concept for r in areas][0] in ("m-1", "flat") and {r.concept: r.len for r in areas} == {"m-1": 6, "flat": 6}
    by = {r.concept: r for r in areas}
    assert by["m-1"]["area"] > by["flat"]["area"] and by["flat"].ic == 0
    assert {r.covariate for r in read["trends"].collect()} == {"len", "ic", "ic_gc"}
    assert {(r.a, r.b): round(r.cosine, 9) for r in read["similarity"].collect() if r.a == r.b and r.insertions == 8}.get(("m-1", "m-1")) == 1.0
    assert "m-1" in spark.read.text(str(tmp_path / "run" / "report"), wholetext=True).first().value
    order = similarity_order(read["similarity"], tables["scores"]).collect()
    assert {(r.insertions, r.concept) for r in order} == {(r.insertions, r.a) for r in read["similarity"].collect()}
    assert all(sorted(r.place for r in order if r.insertions == n) == list(range(sum(r.insertions == n for r in order))) for n in (1, 8)) and all(r.log_ratio == scores[r.insertions, r.concept].log_ratio for r in order)


def test_run_of_every_kind_of_concept(spark):
    """Consensus motifs, regions of a genome, signal, synthetic GC content and given sequences against a random control, without components."""
    rng = np.random.default_rng(6)
    chrom = "".join(rng.choice(list("ACGT"), 30_000, p=[0.3, 0.2, 0.2, 0.3]))
    rich = "".join(rng.choice(list("ACGT"), 10_000, p=[0.05, 0.45, 0.45, 0.05]))
    genome = spark.createDataFrame([("c1", 0, chrom), ("c2", 0, rich)], "chrom string, chunk_start long, seq string")
    sizes = spark.createDataFrame([("c1", 30_000)], "chrom string, length long")
    control = ConceptBuilder.from_genome(sizes, genome, 100, 150, seed=3).control
    consensus = spark.createDataFrame([("poly", "GCGCGCGC"), ("poly", "GGGGCCCC")], "motif string, consensus string")
    places = lambda c, name, chrom, n: [(name, chrom, 100 + 60 * i, 140 + 60 * i) for i in range(n)]
    regions = spark.createDataFrame(places(0, "rich", "c2", 150) + places(0, "plain", "c1", 150), "concept string, chrom string, start long, stop long")
    loud = spark.createDataFrame(places(0, "loud", "c1", 150), regions.schema)
    signal = spark.createDataFrame([("c1", 0, 30_000, 3.0)], "chrom string, start long, stop long, value double")

    def others(builder):
        return builder.add_regions(regions, genome, 100).add_tracks(loud, signal, 100).add_synthetic_gc(0.5, 150, 100)

    tables = run_concepts(control, S.kmer_and_track_shares, Q.network(68), consensus=consensus, others=others, insertions=(1, 6), components=0, per_component=50, per_concept=100)
    scores = {(r.insertions, r.concept): r.fscore for r in tables["scores"].collect()}
    assert set(scores) == {(1, "poly"), (6, "poly")} | {(0, c) for c in ("rich", "plain", "loud", "synthetic_gc_0.00", "synthetic_gc_0.50", "synthetic_gc_1.00")}
    clear = [scores[0, c] for c in ("rich", "loud", "synthetic_gc_0.00", "synthetic_gc_1.00")] + [scores[6, "poly"]]
    assert min(clear) > 0.9 > scores[0, "plain"]  # regions like the control can't be told from it
    [area] = tables["areas"].collect()
    assert area.concept == "poly" and area.len == 8 and area.gc == 8
    with pytest.raises(ValueError):
        run_concepts(control, S.kmer_shares, Q.network(), control_kind="none", consensus=consensus)
    with pytest.raises(ValueError):
        run_concepts(control, S.kmer_shares, Q.network())


def test_one_branch_for_all_motifs(spark):
    """The plan has one pass over the control, whatever the number of motifs, and makes what single insertions make."""
    control = spark.createDataFrame([(i, "ACGT" * 20) for i in range(5)], "seq_id long, seq string")
    few, many = ConceptBuilder(control, 2), ConceptBuilder(control, 2)
    few.add_motif("a", np.eye(4))
    for i in range(60):
        many.add_motif(f"m{i}", np.eye(4)[[i % 4, 1, 2, 0]], permuted=True)
    plans = [b.samples()._jdf.queryExecution().optimizedPlan().toString() for b in (few, many)]
    assert [p.count("MapInArrow") for p in plans] == [1, 1] and plans[0].count("\n") == plans[1].count("\n")
    assert many.motif_samples().groupBy("concept").count().count() == 120
    got = {(r.seq_id, r.seq) for r in many.motif_samples().filter("concept = 'm7'").collect()}
    assert got == {(r.seq_id, r.seq) for r in S.with_motifs(control, np.eye(4)[[3, 1, 2, 0]], 2).collect()}


def test_builders(spark, tmp_path):
    rng = np.random.default_rng(1)
    chrom = "".join(rng.choice(list("ACGT"), 5000))
    genome = spark.createDataFrame([("c1", 0, chrom[:3000]), ("c1", 3000, chrom[3000:])], "chrom string, chunk_start long, seq string")
    sizes = spark.createDataFrame([("c1", 5000)], "chrom string, length long")
    builder = ConceptBuilder.from_genome(sizes, genome, 100, 30, motifs_per_sequence=2, least=2)
    control = builder.control.collect()
    assert len(control) == 30 and all(r.seq in chrom and len(r.seq) == 100 for r in control)
    consensus = spark.createDataFrame([("a/b", "AACCGG"), ("a/b", "TTTTTTC")], "motif string, consensus string")
    pwm = spark.createDataFrame([(m, i + 1, *map(float, np.eye(4)[i])) for m in ("x", "y") for i in range(4)], "motif string, pos int, a double, c double, g double, t double")
    regions = spark.createDataFrame([("r", "c1", 100, 140, "-"), ("r", "c1", 200, 260, "+"), ("few", "c1", 50, 90, "+")], "concept string, chrom string, start long, stop long, strand string")
    signal = spark.createDataFrame([("c1", 105, 110, 2.0), ("c1", 110, 112, 3.0), ("c1", 118, 500, 1.0)], "chrom string, start long, stop long, value double")
    builder.add_custom_motifs(consensus).add_meme_motifs(pwm, ["x"], permuted=True).add_regions(regions, genome, 20).add_tracks(regions, signal, 20)
    by = defaultdict(list)
    for r in builder.samples().collect():
        by[r.concept, r.role].append(r.seq)
    assert {k: len(v) for k, v in by.items()} == {("control", "control"): 30, ("a-b", "test"): 30, ("x", "test"): 30, ("x_permuted", "permuted"): 30, ("r", "test"): 2}
    used = Counter(w for s in by["a-b", "test"] for w in ("AACCGG", "CCGGTT", "TTTTTTC", "GAAAAAA") if w in s)
    assert set(used) == {"AACCGG", "CCGGTT", "TTTTTTC", "GAAAAAA"}  # variants and reverse complements all occur
    assert all("ACGT" in s for s in by["x", "test"])
    flipped = chrom[110:130].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert sorted(by["r", "test"]) == sorted([flipped, chrom[220:240]])
    tracks = {tuple(r.track) for r in builder.paired_tracks().collect()}
    assert tracks == {(3.0, 3.0) + (0.0,) * 6 + (1.0,) * 12, (1.0,) * 20}
    lower = builder.apply_transform(lambda d: d.withColumn("seq", F.lower("seq"))).samples()
    assert lower.filter(F.col("seq") != F.lower("seq")).count() == 0
    with pytest.raises(ValueError):
        builder.add_motif("z", np.eye(4)[:1], permuted=True)


def test_both_descents_and_paired_controls(spark):
    rng = np.random.default_rng(3)
    data = [(i, "abc"[i % 3], (rng.normal(size=6) + np.eye(6)[i % 3] * 5).tolist()) for i in range(330)]
    rows = spark.createDataFrame(data, "id long, concept string, emb array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "concept string, control string")
    samples = C.samples_for_pairs(rows, pairs, 100)
    assert {(r.concept, r.truth): r["count"] for r in samples.groupBy("concept", "truth").count().collect()} == {(c, t): 100 for c in "ab" for t in (0, 1)}
    for method in ("l2", "l1", "adamw"):
        got = {r.concept: r for r in C.train(samples, method).collect()}
        assert all(r.fscore > 0.9 and r.train_accuracy > 0.9 and r.decay in C.DECAYS[method] for r in got.values())
        w = np.array(got["a"].w)
        assert w[0] > 0 > w[1] and np.array(got["b"].w)[1] > 0 > np.array(got["b"].w)[2]
    x, sign = rng.normal(size=(200, 12)), np.where(rng.random(200) < 0.5, 1.0, -1.0)
    x[:, 0] += 4 * sign
    assert (np.abs(C.sgd(x, sign, 0.5, "l1")[1:-1]) < 0.02).mean() > (np.abs(C.sgd(x, sign, 0.5, "l2")[1:-1]) < 0.02).mean() - 1e-9


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbers_over_any_partitions(spark, by):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(t), None if t % 5 == 0 else "ab"[t % 2]) for t, k in enumerate(rng.integers(0, 40, 300))]
    frame = spark.createDataFrame(rows, "k long, t long, g string").repartition(5)
    got = R.numbered(frame, "k", "t", by=by).collect()
    seen, want = Counter(), {}
    for k, t, g in sorted(rows, key=lambda r: (r[0], r[1])):
        want[t] = seen[g if by else 0]
        seen[g if by else 0] += 1
    assert {r.t: r.ordinal for r in got} == want and sorted(got[0].asDict()) == sorted([*frame.columns, "ordinal"])
    assert R.numbered(frame.limit(0), "k", "t", by=by).count() == 0


def test_averages_across_runs(spark, monkeypatch):
    monkeypatch.setattr(I, "RUN", 12)
    values = np.random.default_rng(4).normal(size=100)
    points = spark.createDataFrame([("c", 0, i, float(v)) for i, v in enumerate(values)], "chrom string, block long, start long, value double")
    for width in (10, 3, 1):
        got = [r.smooth for r in I.moving_average(points, width).orderBy("start").collect()]
        want = [values[max(0, i - width // 2) : i + width - width // 2].sum() / width for i in range(100)]
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        I.moving_average(points, 13)


def test_permutations_fail_loudly(spark):
    rows = spark.createDataFrame([("a", "ACGTTGCA"), ("b", "A")], "motif string, consensus string")
    with pytest.raises(Exception, match="no permutation"):
        M.permuted(rows, 0.3, "1").collect()
    assert len(M.permuted(rows.filter("motif = 'a'"), 0.3, "1").collect()) == 1


def test_indexed_fasta(spark, tmp_path):
    rng = np.random.default_rng(7)
    chroms = {name: "".join(rng.choice(list("acgtN"), n)) for name, n in (("c1", 905), ("c2", 60), ("c3", 7), ("c4", 240))}
    text, index = "", []
    for name, seq in chroms.items():
        text += f">{name} about\n"
        index.append((name, len(seq), len(text), 60, 61))
        text += "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n"
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "g.fa.fai").write_text("\n".join("\t".join(map(str, r)) for r in index) + "\n")
    got = files.read_indexed_fasta(spark, str(tmp_path / "g.fa"), str(tmp_path / "g.fa.fai"), 120).collect()
    assert {(r.chrom, r.chunk_start): r.seq for r in got} == {(c, i): s[i : i + 120].upper() for c, s in chroms.items() for i in range(0, len(s), 120)}
    lines = files.read_indexed_fasta(spark, str(tmp_path / "g.fa"), str(tmp_path / "g.fa.fai"), 100).collect()
    assert {(r.chrom, r.chunk_start): r.seq for r in lines} == {(c, i): s[i : i + 60].upper() for c, s in chroms.items() for i in range(0, len(s), 60)}


def test_sources_by_suffix(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\n>b\nGGGG\n")
    (tmp_path / "x.bed").write_text("c1\t2\t6\nc1\t0\t3\n")
    genome = spark.createDataFrame([("c1", 0, "ACGTACGTAC")], "chrom string, chunk_start long, seq string")
    assert {tuple(r) for r in files.read_source(spark, str(tmp_path / "x.fa")).select("name", "seq").collect()} == {("a", "ACGT"), ("b", "GGGG")}
    assert {tuple(r) for r in files.read_source(spark, str(tmp_path / "x.bed"), genome).collect()} == {("c1:2-6", "GTAC"), ("c1:0-3", "ACG")}
    with pytest.raises(ValueError):
        files.read_source(spark, str(tmp_path / "x.txt"))


def test_signal_writer(spark, tmp_path):
    rows = [(1, "c", 4, 8, [1.0, 2.0, 3.0, 4.0]), (2, "c", 6, 10, [9.0] * 4), (3, "c", 20, 22, [5.0, 7.0])]
    regions = spark.createDataFrame(rows, "region_id long, chrom string, start long, stop long, x array<double>")
    files.write_signal(regions, "x", str(tmp_path / "plain"))
    read = lambda name: {p: r.value for r in files.read_tsv(spark, str(tmp_path / name), files.BEDGRAPH).collect() for p in range(r.start, r.stop)}
    values = {4: 1.0, 5: 2.0, 6: 3.0, 7: 4.0, 8: 9.0, 9: 9.0, 20: 5.0, 21: 7.0}
    assert read("plain") == values
    files.write_signal(regions, "x", str(tmp_path / "smooth"), smooth=True, width=4)
    block = lambda p: range(4, 10) if p < 10 else range(20, 22)
    want = {p: sum(values[q] for q in range(p - 2, p + 2) if q in block(p)) / 4 for p in values}
    got = read("smooth")
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_pages_say_what_they_leave_out(spark):
    text = page("t", {"long": spark.range(ROWS + 5), "short": spark.range(3)})
    assert text.count(f"The first {ROWS} rows") == 1 and '"id": 2' in text


def test_scores_need_a_control(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 1.0], 2), (3, None, 0), (4, [None, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalogue.QUERIES[catalogue.FLAGSHIP](spark, str(tmp_path)).collect() == []


def test_matrix_draws(spark):
    rng = np.random.default_rng(0)
    matrix = rng.dirichlet((2, 1, 3, 0.5), 6)
    one, two = ([r.seq for r in M.drawn(s, matrix, 20_000, 5).orderBy("draw").collect()] for s in (spark, spark))
    assert one == two and len(one) == 20_000 and one != [r.seq for r in M.drawn(spark, matrix, 20_000, 6).orderBy("draw").collect()]
    shares = np.array([[sum(x[i] == c for x in one) for c in "ACGT"] for i in range(6)]) / len(one)
    assert np.abs(shares - matrix).max() < 0.02
    assert {r.seq for r in M.drawn(spark, np.eye(4), 3_000, 1).collect()} == {"ACGT"}


def test_stored_tables_can_go(spark):
    rows = stored(spark.range(5), "five")
    assert rows.count() == 5
    discard(rows, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(rows._stored_at).count()


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(100)]
    (tmp_path / "g.fa").write_text(">c1\n" + "\n".join(lines) + "\n")
    (tmp_path / "g.fai").write_text("c1\t6000\t4\t60\t61\n")
    (tmp_path / "c.bed").write_text("".join(f"c1\t{i}\t{i + 10}\n" for i in range(200, 5600, 90)))
    rows = "\n".join(" ".join("0.97" if i == j % 4 else "0.01" for i in range(4)) for j in range(6))
    (tmp_path / "m.meme").write_text(f"MEME version 4\n\nMOTIF x\nletter-probability matrix: alength= 4 w= 6 nsites= 20 E= 0\n{rows}\n\nMOTIF y\nletter-probability matrix: alength= 4 w= 3 nsites= 20 E= 0\n" + "0.25 0.25 0.25 0.25\n" * 3)
    layers = Q.network()
    np.savez(tmp_path / "net.npz", **{f"{k}{i}": v for i, layer in enumerate(layers) for k, v in (("weight", layer.weight), ("bias", layer.bias))})
    assert all(np.allclose(a.weight, b.weight) and np.allclose(a.bias, b.bias) for a, b in zip(A.load_layers(spark, str(tmp_path / "net.npz")), layers))
    given = [f"--{k}={tmp_path / v}" for k, v in (("genome", "g.fa"), ("fai", "g.fai"), ("motifs", "m.meme"), ("layers", "net.npz"), ("out", "out"))]
    command.main([*given, "--kmers", "--window=100", "--samples=40", "--insertions", "1", "4", "--edges", "0", "60", "100", f"--control={tmp_path / 'c.bed'}"])
    for name in ("from0to60", "from60to100"):
        found = spark.read.parquet(str(tmp_path / "out" / name / "scores")).collect()
        assert {(r.insertions, r.concept) for r in found} == {(n, c) for n in (1, 4) for c in "xy"}
    args = command.parsed([*given, "--bins=4", "--window=100"])
    assert list(command.buffers(args).values()) == [(0, 75), (25, 50), (50, 25), (75, 0)]
    genome = files.read_indexed_fasta(spark, args.genome, args.fai)
    args.samples = 12
    assert command.control_sequences(spark, args, genome).count() == 12


def test_attribution_commands(spark, tmp_path):
    """A run on a network of sequences with regions, signal and GC content; then attributions at a layer and of letters, which add up."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("ACGT"), 9_000))
    (tmp_path / "g.fa").write_text(">c1\n" + "\n".join(text[i : i + 60] for i in range(0, 9_000, 60)) + "\n")
    (tmp_path / "g.fai").write_text("c1\t9000\t4\t60\t61\n")
    (tmp_path / "r.bed").write_text("".join(f"c1\t{i}\t{i + 10}\t+\tpart{i // 10 % 2}\n" for i in range(200, 8_600, 70)))
    (tmp_path / "t.bed").write_text("".join(f"c1\t{i}\t{i + 9}\n" for i in range(300, 900, 100)) + "c2\t5\t9\n")
    (tmp_path / "m.tsv").write_text("x\tGGGGCCCC\nx\tGCGCGCGC\ny\tATATATAT\n")
    bigwig.write_bigwig(spark.createDataFrame([("c1", 0, 9_000, 2.0)], "chrom string, start long, stop long, value double"), str(tmp_path / "bw"))
    layers, held = Q.sequence_network(64), {}
    for i, layer in enumerate(layers):
        held |= {f"pool{i}": np.array(layer)} if isinstance(layer, A.MaxPool) else {f"weight{i}": layer.weight, f"bias{i}": layer.bias} | ({f"length{i}": layer.length} if isinstance(layer, A.Convolution) else {})
    np.savez(tmp_path / "net.npz", **held)
    assert [type(x) for x in A.load_layers(spark, str(tmp_path / "net.npz"))] == [type(x) for x in layers]
    given = [f"--{k}={tmp_path / v}" for k, v in (("genome", "g.fa"), ("fai", "g.fai"), ("layers", "net.npz"))] + ["--window=64", "--upto=4"]
    command.main(["run", *given, f"--out={tmp_path / 'run'}", "--consensus", str(tmp_path / "m.tsv"), f"--regions={tmp_path / 'r.bed'}", "--gc-step=1", "--samples=80", "--insertions", "1", "5", "--components=4"])
    scores = {(r.insertions, r.concept): r.fscore for r in spark.read.parquet(str(tmp_path / "run" / "whole" / "scores")).collect()}
    assert set(scores) == {(n, c) for n in (1, 5) for c in "xy"} | {(0, c) for c in ("part0", "part1", "synthetic_gc_0.00", "synthetic_gc_1.00")}
    assert max(scores.values()) > 0.6  # of a network that was never trained
    more = [*given, f"--targets={tmp_path / 't.bed'}", f"--trained={tmp_path / 'run' / 'whole'}", "--baselines=3", "--chroms", "c1"]
    command.main(["layer", *more, f"--out={tmp_path / 'layer'}"])
    read = files.read_run(spark, str(tmp_path / "layer"), ["embeddings", "attributions", "predictions"])
    model = T.load_model(spark, str(tmp_path / "run" / "whole" / "model"))
    x = A.one_hot(pa.array([text[i + 4 - 32 : i + 4 + 32] for i in range(300, 900, 100)]), 64)
    outputs = A.forward(x, layers)
    assert sorted(round(r.output, 6) for r in read["predictions"].collect()) == sorted(round(float(v), 6) for v in outputs[-1][:, 0])
    assert np.allclose(sorted(r.emb[0] for r in read["embeddings"].collect()), sorted(pca.project(outputs[4], model)[0][:, 0]), atol=1e-6)
    assert {len(r.a) for r in read["attributions"].collect()} == {len(model.mean) + 4}
    command.main(["inputs", *more, f"--out={tmp_path / 'inputs'}", "--concepts", "x", "synthetic_gc_1.00"])
    letters = spark.read.parquet(str(tmp_path / "inputs" / "letters")).collect()
    assert len(letters) == 6 and all(np.isclose(sum(r.total), r.difference, atol=1e-9) and np.allclose(np.add(r.inside, r.outside), r.total, atol=1e-9) for r in letters)
    table = [(r.region, r.total, r.inside) for r in files.read_tsv(spark, str(tmp_path / "inputs" / "regions"), "region string, total double, inside double, outside double").collect()]
    assert {r[0] for r in table} == {f"c1:{i + 4 - 32}-{i + 4 + 32}" for i in range(300, 900, 100)}
    assert [r[2] for r in table] == sorted((r[2] for r in table), reverse=True) and np.allclose(sorted(r[1] for r in table), sorted(sum(r.total) for r in letters))
    track = bigwig.read_bigwig(spark, str(tmp_path / "inputs" / "total")).agg(F.sum((F.col("stop") - F.col("start")) * F.col("value"))).first()[0]
    assert np.isclose(track, sum(sum(r.total) for r in letters), atol=1e-3)


def test_sequence_network_query(spark):
    """Attributions of letters add up to the difference of the outputs; outputs one by one, window by window."""
    def output(seq):
        x = np.array([[c == b for c in seq.ljust(64, "N")] for b in "ACGT"], float)
        for layer in Q.sequence_network():
            if isinstance(layer, A.Convolution):
                x = np.maximum([[(layer.weight[o] * x[:, i : i + layer.weight.shape[2]]).sum() + layer.bias[o] for i in range(x.shape[1] - layer.weight.shape[2] + 1)] for o in range(len(layer.weight))], 0)
            elif isinstance(layer, A.MaxPool):
                x = np.array([[c[i : i + layer.width].max() for i in range(0, len(c) - layer.width + 1, layer.stride)] for c in x])
            else:
                x = x.ravel() @ layer.weight + layer.bias
                x = np.maximum(x, 0) if layer.weight.shape[1] > 1 else x
        return float(x[0])

    rows = ran(spark, "j8_sequence_attribution")
    seqs = {r.seq_id: r.seq for r in P.sequences(spark, SF).collect()}
    assert {(r.seq_id, r.start) for r in rows} == {(i, k) for i, s in seqs.items() for k in range(0, len(s), 64)}
    assert all(len(r.a) == 64 and np.isclose(sum(r.a), r.difference, atol=1e-9) for r in rows) and any(abs(r.difference) > 0.01 for r in rows)
    for r in rows[:: max(1, len(rows) // 40)]:
        own = seqs[r.seq_id][r.start : r.start + 64]
        assert np.isclose(r.difference, output(own) - output(own[::-1]), atol=1e-9)


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_rules_of_every_layer(stride):
    """Convolution and pooling one window at a time, gradients where nothing differs, and sums that equal the difference."""
    rng = np.random.default_rng(stride)
    conv = A.Convolution(rng.normal(size=(5, 3, 4)), rng.normal(size=5), 20)
    pool = A.MaxPool(5, 17, 4, stride)
    n = len(range(0, 14, stride))
    layers = [conv, pool, A.Dense(rng.normal(size=(5 * n, 6)), rng.normal(size=6)), A.Dense(rng.normal(size=(6, 2)), rng.normal(size=2))]
    x, base = rng.normal(size=(2, 9, 60))
    base[0], base[1, :30] = x[0], x[1, :30]
    seen = A.forward(x, layers)
    grid = x.reshape(9, 3, 20)
    want = np.array([[[max(0, (conv.weight[o] * g[:, i : i + 4]).sum() + conv.bias[o]) for i in range(17)] for o in range(5)] for g in grid])
    assert np.allclose(seen[1], want.reshape(9, -1))
    assert np.allclose(seen[2], np.array([[[c[i : i + 4].max() for i in range(0, 14, stride)] for c in w] for w in want]).reshape(9, -1))
    m = A.multipliers(x, base, layers)
    assert np.allclose((m * (x - base)).sum(axis=1), seen[-1][:, 0] - A.forward(base, layers)[-1][:, 0]) and np.isfinite(m).all()
    step = np.zeros_like(x[:1])
    slopes = []
    for i in range(60):
        step[:] = 0
        step[0, i] = 1e-6
        slopes.append((A.forward(x[:1] + step, layers)[-1] - A.forward(x[:1] - step, layers)[-1])[0, 0] / 2e-6)
    assert np.allclose(m[0], slopes, atol=1e-5)  # where sample and baseline are the same
    assert np.allclose(A.one_hot(pa.array(["ACNx", "t", None, "GGGGT"]), 5).reshape(4, 4, 5).sum(axis=(1, 2)), [2, 0, 0, 5])
    with pytest.raises(ValueError):
        A.one_hot(pa.array(["ACGT"]), 3)


def test_small_components_keep_their_digits(spark):
    """Singular values down to 1e-7 of the largest, which squares lose; over many partitions, and by the randomised range finder."""
    rng = np.random.default_rng(4)
    axes, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    x = rng.normal(size=(900, 2)) @ axes[:2] + rng.normal(size=(900, 12)) * 1e-7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(23)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = np.linalg.svd(z, compute_uv=False) ** 2 / 899
    got = pca.fit(rows)
    assert want[-1] < 1e-12 and np.allclose(got.variances, want, rtol=1e-4, atol=0)
    squares = np.linalg.eigvalsh(z.T @ z / 899)[::-1]
    assert not np.allclose(squares, want, rtol=1e-2, atol=0)  # what the moment form gives
    wide = pca.fit_wide(rows, 2, more=2)
    assert np.allclose(wide.variances, want[:2]) and np.allclose(np.abs((wide.components * got.components[:2]).sum(axis=1)), 1)
    assert np.allclose(pca.correlation(rows), np.corrcoef(x.T), atol=1e-9)


def test_merges_are_bounded(spark):
    """No task and no collection gets more than FAN parts."""
    rows = spark.range(4_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")).repartition(70)
    fans = []

    def merge(lists):
        assert len(lists) <= pca.FAN
        fans.append(len(lists))
        return [sum(x for [x] in lists)]

    [total] = pca.in_rounds(rows, lambda x: [sum((m.sum(axis=0) for m in x), np.zeros(2))], merge)
    assert total.tolist() == [7_998_000.0, 4_000.0] and max(fans) <= 8


def test_odd_vectors(spark, tmp_path):
    """Null, not finite and uneven vectors take no part, and an empty table has no components; in every query of vectors."""
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(90)]
    odd = [(200, None, 0), (201, [1.0, None] * 32, 1), (202, [float("nan")] * 64, 2), (203, [float("inf")] + [0.0] * 63, 0), (204, [1.0] * 7, 1), (205, [], 2), (None, [0.5] * 64, 1), (206, good[0][1], None)]
    schema = "vec_id long, embedding array<float>, label int"
    for name, rows in (("odd", good + odd), ("good", good), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    names = [catalogue.FLAGSHIP, "i1_leading_components", "i3_pca_variance", "i4_project", "i5_embeddings", "i6_restored", "i7_cav_subspace", "i8_direction_scores", "i9_centroid_cosine", "i10_cluster_order", "e1_zscore_stats", "b14_zscores", "e14_mean_directions", "e15_mean_abs_corr", "e19_cluster_similarity", "j1_classifiers", "j2_adamw_classifiers", "j3_prepare_samples", "j5_paired_controls", "j6_layer_output", "j7_patched_output", "j8_mlp_attribution", "j9_input_attributions", "k5_concept_run"]
    for name in names:
        assert catalogue.QUERIES[name](spark, str(tmp_path / "empty")).collect() == [], name
    for name in (catalogue.FLAGSHIP, "e1_zscore_stats", "i3_pca_variance", "i8_direction_scores", "j8_mlp_attribution"):
        got = catalogue.QUERIES[name](spark, str(tmp_path / "odd")).collect()
        assert got and not any(isinstance(v, float) and math.isnan(v) for r in got for v in r), name
    a, b = (sorted(catalogue.QUERIES[catalogue.FLAGSHIP](spark, str(tmp_path / x)).collect()) for x in ("odd", "good"))
    assert [r[:4] for r in a] and {r.concept for r in a} == {r.concept for r in b} == {1, 2}


def test_chains_cluster_like_the_nearest_pair(spark):
    """Average linkage one nearest pair at a time, in cubic time, and 1,500 concepts in seconds."""
    def slow(similarity):
        groups, distance = [[i] for i in range(len(similarity))], 1 - similarity
        for _ in range(len(similarity) - 1):
            pairs = [(distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
            yield [sorted(g) for g in groups]
            _, i, j = min(pairs)
            groups[i] = groups[i] + groups.pop(j)
        yield [sorted(g) for g in groups]

    for seed in range(5):
        x = np.random.default_rng(seed).normal(size=(11, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for groups in slow(x @ x.T):
            labels = pca.clusters(x @ x.T, len(groups))
            assert sorted(sorted(np.flatnonzero(np.array(labels) == k).tolist()) for k in set(labels)) == sorted(groups)
        assert sorted(pca.average_linkage_order(x @ x.T)) == list(range(11))
    x = np.random.default_rng(9).normal(size=(1_500, 8))
    began = time.monotonic()
    assert len(set(pca.clusters(x @ x.T / 8, 40))) == 40 and time.monotonic() - began < 20


def test_exact_median(spark):
    """Against Python's, for even and odd numbers, ties, far apart values, nulls and a hot group."""
    rng = np.random.default_rng(2)
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 7 + [4.0] * 7, "far": [-1e308, 1e308, 1e-300, -1e-300, 0.0], "hot": rng.normal(size=9_001).tolist(), "even": rng.integers(0, 50, 800).astype(float).tolist(), None: [1.0, 9.0, 2.0], "skewed": (10.0 ** rng.integers(-200, 200, 701)).tolist()}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for rows, cells, small in ((frame, 256, 4_096), (frame.filter("g IN ('ties', 'hot')"), 64, 300)):
        got = {r.g: r.median for r in X.exact_median(rows, "g", "v", cells, small).collect()}
        assert got and all(m == statistics.median(groups[g]) for g, m in got.items())
        assert small < 4_096 or got.keys() == groups.keys()
    assert X.exact_median(frame.limit(0), "g", "v").count() == 0


def test_p_values_of_lines(spark):
    """Tabulated tails of Student's distribution, and integrals of its density."""
    table = [(10, 2.228138851964939, 0.05), (1, 12.706204736432095, 0.05), (30, 2.749995653567231, 0.01), (5, 6.868826625881396, 0.001), (2, 0.816496580927726, 0.5)]
    rows = spark.createDataFrame([(float(n), t, p) for n, t, p in table], "n double, t double, want double")
    x = F.col("n") / (F.col("n") + F.col("t") * F.col("t"))
    for r in rows.withColumn("p", X.incomplete_beta(F.col("n") / 2, F.lit(0.5), x)).collect():
        assert abs(r.p - r.want) < 1e-9
    big = spark.createDataFrame([(10_000_000.0, 1.959963984540054), (400_000.0, 0.0), (3.0, 1e9)], "n double, t double")
    assert np.allclose([r.p for r in big.withColumn("p", X.incomplete_beta(F.col("n") / 2, F.lit(0.5), x)).collect()], [0.05, 1, 0], atol=1e-6)
    got = {r.brand: r.p for r in ran(spark, "e9_p_values")}
    points = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        points[r.p_brand].append((float(r.p_size), float(r.p_retailprice)))
    assert got.keys() == points.keys()
    for brand, xy in points.items():
        a, b = np.array(xy).T
        if len(xy) > 2 and a.std() and b.std():
            r, n = np.corrcoef(a, b)[0, 1], len(xy) - 2
            t = abs(r) * math.sqrt(n / max(1e-300, 1 - r * r))
            grid = np.linspace(0, 1, 200_001)[1:]  # the tail beyond t, with t/u for its places
            u = t / grid
            density = (1 + u * u / n) ** (-(n + 1) / 2) * t / grid**2
            tail = 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (density.sum() - density[-1] / 2) / 200_000
            assert abs(got[brand] - tail) < 1e-5


def test_range_finder_query(spark, data):
    _, x, _ = data
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    got = sorted(ran(spark, "i1_leading_components"))
    assert [r.pc for r in got] == list(range(Q.COMPONENTS)) and np.allclose([r.share for r in got], (s / s.sum())[: Q.COMPONENTS], rtol=0.02)


def test_run_stores_little(spark, monkeypatch):
    """Vectors are stored whole for the components only, embeddings of drawn samples only, and neither stays."""
    from larkspur.plans import run

    tables = []

    def kept(rows, what, **options):
        tables.append((what, stored(rows, what, **options)))
        counts.setdefault(what, []).append(tables[-1][1].count())
        return tables[-1][1]

    counts = {}
    monkeypatch.setattr(run, "stored", kept)
    rng = np.random.default_rng(2)
    control = spark.createDataFrame([(i, "".join(rng.choice(list("ACGT"), 60))) for i in range(40)], "seq_id long, seq string")
    found = run_concepts(control, S.kmer_shares, Q.network(), sharp_and_flat(spark), insertions=(1, 2, 4), control_kind="permuted", per_concept=10)
    assert counts["vectors"] == [40 * 3] and counts["embedded"] == [10 * 5] * 3
    with_files = {what for what, rows in tables if spark._jvm.java.io.File(rows._stored_at.removeprefix("file:")).exists()}
    assert with_files == {"directions", "scores", "areas"}
    assert {n: t.count() for n, t in found.items() if n in ("scores", "areas", "directions")} == {"scores": 6, "areas": 2, "directions": 6}


def test_all_concepts_use_whole_texts(spark, monkeypatch):
    """Control and synthetic sequences are as long as the texts' letters; regions and consensus stretches leave no letter out."""
    given = {}
    monkeypatch.setattr(Q, "run_concepts", lambda control, *rest, **named: given.update(control=control, **named) or {"scores": None})
    Q.k5_all_concepts(spark, SF)
    seqs = {r.seq_id: r.seq for r in P.sequences(spark, SF).collect()}
    assert {r.seq_id: r.seq for r in given["control"].collect()} == seqs and max(map(len, seqs.values())) > 1000
    builder = given["others"](ConceptBuilder(given["control"]))
    rows = builder.samples().withColumn("kind", F.split("concept", "_")[0])
    for r in rows.filter("kind = 'synthetic'").groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("seq_id", F.length("seq")))).alias("sizes")).collect():
        assert r.sizes == {i: len(s) for i, s in seqs.items() if s}
    got = Counter(r.seq for r in rows.filter("kind = 'region'").collect())
    want = Counter(s[a : a + 64] for s in seqs.values() if len(s) >= 64 for a in {*range(0, len(s) - 63, 64), len(s) - 64})
    assert got == want
    stretches = defaultdict(set)
    for r in given["consensus"].collect():
        stretches[r.motif].add(r.consensus)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        letters = "".join(c for c in r.text.upper() if c in "ACGT") if r.text else ""
        assert all(letters[a : a + 12] in stretches[f"M{r.item_id % 3}"] for a in {*range(0, len(letters) - 11, 12), max(0, len(letters) - 12)} if letters)


def test_synthetic_gc_in_one_pass(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS seq_id", "id AS length").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS seq_id, 9L AS length"))
    parts = {n: {(r.concept, r.seq_id): r.seq for r in S.with_synthetic_gc(rows.repartition(n), {"a": 0.0, "b": 0.3, "c": 1.0}, 4).collect()} for n in (1, 5)}
    assert parts[1] == parts[5] and {k: len(v) for k, v in parts[1].items()} == {(c, i): i or 9 for c in "abc" for i in (None, *range(1, 300))}
    for c, gc in (("a", 0), ("b", 0.3), ("c", 1)):
        text = "".join(v for (k, _), v in parts[1].items() if k == c)
        assert all(abs(text.count(x) / len(text) - (gc if x in "CG" else 1 - gc) / 2) < 0.01 for x in "ACGT")
