"""Vector, component, classifier and attribution operators over the embeddings table."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import functions as F

from larkspur.functions.hashing import uniform, uniform_sql
from larkspur.operators import attribution as A
from larkspur.operators import classifiers as C
from larkspur.operators import pca, sequences
from larkspur.operators import vectors as V
from larkspur.plans import proxies as P
from larkspur.plans.run import run_concepts
from larkspur.plans.scoring import LONG_SQL
from larkspur.sources.storage import stored, table

COMPONENTS, DIRECTIONS, PER_CONCEPT = 8, 4, 200


def _long(spark, sf_dir):
    return V.long_form(V.sound(table(spark, sf_dir, "embeddings"), "embedding"), "embedding", "vec_id", "label")


def _vectors(spark, sf_dir):
    sound = V.sound(table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL"), "embedding")
    return sound.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("concept"))


def e1_zscore_stats(spark, sf_dir):
    stats = V.zscore_stats(_long(spark, sf_dir))
    return stats.select("d", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def b14_zscores(spark, sf_dir):
    long = _long(spark, sf_dir)
    return V.standardised(long, V.zscore_stats(long)).select("vec_id", "d", F.round("z", 6).alias("z"))


def b15_destandardise(spark, sf_dir):
    long = _long(spark, sf_dir)
    back = V.standardised(long, V.zscore_stats(long)).withColumn("back", F.col("z") * F.col("std") + F.col("mean"))
    return back.groupBy("vec_id").agg(F.round(F.sum("back"), 5).alias("total"))


def e14_mean_directions(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("label", "d").agg(F.round(F.avg("v"), 6).alias("w"))


def i9_centroid_cosine(spark, sf_dir):
    means = _long(spark, sf_dir).groupBy(F.col("label").alias("concept"), "d").agg(F.avg("v").alias("v"))
    rows = means.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("w"))
    return C.cosine(rows).select("a", "b", F.round("cosine", 6).alias("cosine"))


def i8_direction_scores(spark, sf_dir):
    axes = spark.range(DIRECTIONS).select(F.col("id").cast("int").alias("concept"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: uniform("6", F.col("id"), d) - 0.5).alias("w"))
    found = C.scores(_vectors(spark, sf_dir).select("id", F.col("vector").alias("a")), axes)
    return found.select("concept", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def i4_project(spark, sf_dir):
    """Standardised vectors on four fixed directions."""
    long = _long(spark, sf_dir)
    axes = spark.range(DIRECTIONS).select(F.col("id").cast("int").alias("pc"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: uniform("6", F.col("id"), d) - 0.5)).alias("d", "w"))
    z = V.standardised(long, V.zscore_stats(long)).join(F.broadcast(axes), "d")
    return z.groupBy("vec_id", "pc").agg(F.round(F.sum(F.col("z") * F.col("w")), 5).alias("p"))


def e15_mean_abs_corr(spark, sf_dir):
    corr = pca.correlation(_vectors(spark, sf_dir))
    off = np.abs(corr[~np.eye(len(corr), dtype=bool)])
    return spark.createDataFrame([(round(float(off.mean()), 6),)] if off.size else [], "mean_abs_corr double")


def j3_prepare_samples(spark, sf_dir):
    rows = C.samples_for(_vectors(spark, sf_dir).withColumnRenamed("vector", "emb"), "0", 40)
    return rows.groupBy("concept", "truth", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def i3_pca_variance(spark, sf_dir):
    model = pca.fit(_vectors(spark, sf_dir))
    share = pca.variance_explained(model)
    return spark.createDataFrame([(i, float(v), float(c)) for i, (v, c) in enumerate(zip(share, share.cumsum()))], "pc int, share double, upto double")


def _embedded(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = pca.fit(rows, COMPONENTS)
    return model, pca.embed(rows, model)


def i5_embeddings(spark, sf_dir):
    _, rows = _embedded(spark, sf_dir)
    return rows.select("id", "emb")


def i6_restored(spark, sf_dir):
    """Vectors from their embeddings."""
    model, rows = _embedded(spark, sf_dir)
    back = pca.restored(rows, model)
    return back.select(F.col("id").alias("vec_id"), F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _named(spark, sf_dir):
    model, rows = _embedded(spark, sf_dir)
    return model, rows.join(_vectors(spark, sf_dir).select("id", "concept").filter("concept IS NOT NULL"), "id")


def _cavs(spark, sf_dir):
    model, named = _named(spark, sf_dir)
    return model, named, stored(C.train(C.samples_for(named, "0", PER_CONCEPT)), "directions")


MEASURES = ("concept", "fscore", "fscore_macro", "accuracy", "train_fscore", "train_accuracy", "decay")


def j1_classifiers(spark, sf_dir):
    """Averaged stochastic descent with either penalty."""
    samples = stored(C.samples_for(_named(spark, sf_dir)[1], "0", PER_CONCEPT), "samples")
    both = [C.train(samples, method).select(F.lit(method).alias("penalty"), *MEASURES) for method in ("l2", "l1")]
    return both[0].unionByName(both[1])


def j2_adamw_classifiers(spark, sf_dir):
    return _cavs(spark, sf_dir)[2].select(*MEASURES)


def j5_paired_controls(spark, sf_dir):
    """Each concept against a control of its own, the next concept."""
    _, named = _named(spark, sf_dir)
    names = sorted(r.concept for r in named.select("concept").distinct().collect())
    pairs = spark.createDataFrame(list(zip(names, names[1:] + names[:1])), "concept string, control string")
    return C.train(C.samples_for_pairs(named, pairs, PER_CONCEPT)).select(*MEASURES)


def j6_layer_output(spark, sf_dir):
    return A.layer_output(_vectors(spark, sf_dir), network(), 2)


def j7_patched_output(spark, sf_dir):
    """The network's output when its input is put together again from embeddings."""
    model, rows = _embedded(spark, sf_dir)
    return A.patched_output(rows, network(), 0, model)


def j9_input_attributions(spark, sf_dir):
    """Attributions of the inputs: in all, through the directions' span at the first layer, and outside it."""
    rows, layers = _vectors(spark, sf_dir), network()
    hidden = A.layer_output(rows, layers, 1)
    model = pca.fit(hidden, COMPONENTS)
    basis = pca.subspace(np.random.default_rng(4).normal(size=(DIRECTIONS, COMPONENTS + 32)))
    pairs = rows.withColumn("base", F.array_repeat(F.lit(0.0), F.size("vector")))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    parts = [A.input_attributions(pairs, layers, 1, model, basis, part).select("id", F.lit(part).alias("part"), total.alias("total")) for part in ("all", "inside", "outside")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def i10_cluster_order(spark, sf_dir):
    """Concepts in the order of average-linkage clustering of their directions."""
    names, similarity = _similarity(_cavs(spark, sf_dir)[2])
    return spark.createDataFrame([(k, names[i]) for k, i in enumerate(pca.average_linkage_order(similarity))], "place int, concept string")


def _similarity(rows):
    """A small matrix of ``concept, w``: names and cosines."""
    pairs = C.cosine(rows).collect()
    names = sorted({r.a for r in pairs})
    at, similarity = {n: i for i, n in enumerate(names)}, np.eye(len(names))
    for r in pairs:
        similarity[at[r.a], at[r.b]] = r.cosine
    return names, similarity


def e19_cluster_similarity(spark, sf_dir):
    """Concepts in at most three clusters of directions, and the mean cosine of vectors with their cluster's directions."""
    _, rows, cavs = _cavs(spark, sf_dir)
    names, similarity = _similarity(cavs)
    of = spark.createDataFrame(list(zip(names, pca.clusters(similarity, 3))), "concept string, cluster int")
    members = cavs.join(of, "concept").select("cluster", "w")
    cosine = C.dot("emb", "w") / F.sqrt(C.dot("emb", "emb") * C.dot("w", "w"))
    return rows.crossJoin(F.broadcast(members)).groupBy("id", "cluster").agg(F.avg(cosine).alias("mean_cosine"))


def j8_sequence_attribution(spark, sf_dir):
    """A network of convolutions and pooling over whole sequences in windows of 64 letters, against each window read backwards: attributions of letters."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(64)))
    windows = P.sequences(spark, sf_dir).filter("seq_id IS NOT NULL AND seq <> ''").select("seq_id", "seq", starts.alias("start"))
    cut = windows.select((F.col("seq_id").cast("long") * 1_000_000_000 + F.col("start")).alias("id"), F.substring(F.col("seq"), F.col("start") + 1, F.lit(64)).alias("seq"))
    found = A.input_attributions(cut.withColumn("base", F.reverse("seq")), sequence_network(), 0)
    return found.select((F.col("id") / 1_000_000_000).cast("long").alias("seq_id"), (F.col("id") % 1_000_000_000).alias("start"), "a", "difference")


def i1_leading_components(spark, sf_dir):
    """The same leading shares by the randomised range finder, without a square matrix."""
    rows = _vectors(spark, sf_dir)
    model = pca.fit_wide(rows, COMPONENTS, passes=8)
    share = model.variances / max(1, int((model.std != -1).sum()))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(share)], "pc int, share double")


def k5_motif_run(spark, sf_dir):
    """The whole run over sequences: motifs of all languages put into whole sequences of documents, shares of 3-letter strings as activations."""
    seqs = P.stored_sequences(spark, sf_dir)
    control, pwm = seqs.select("seq_id", "seq"), stored(P.pwm(spark, sf_dir, seqs), "pwm")
    return run_concepts(control, sequences.kmer_shares, network(), pwm=pwm, insertions=(2, 8), components=COMPONENTS, per_concept=PER_CONCEPT, control_kind="permuted")["scores"]


def k5_all_concepts(spark, sf_dir):
    """A run of consensus motifs in whole sequences with further concepts: regions that cover sequences, their signal, and synthetic GC content of the lengths of sequences; random control."""
    seqs = P.stored_sequences(spark, sf_dir)
    control, long = seqs.select("seq_id", "seq"), seqs.filter("length(seq) >= 64").withColumn("chrom", F.col("seq_id").cast("string"))
    genome = P.genome(long, 256)
    # Windows of 64 letters one after another, and the last one where the sequence ends.
    last = F.length("seq") - 64
    starts = F.array_distinct(F.concat(F.sequence(F.lit(12), last + 12, F.lit(64)), F.array(last + 12))).cast("array<long>")
    regions = long.select(F.concat(F.lit("region_"), F.coalesce("lang", F.lit("und"))).alias("concept"), "chrom", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + 40)
    middle = F.floor(F.length("seq") / 2 - 20)
    tracks = long.select(F.concat(F.lit("track_"), F.coalesce("lang", F.lit("und"))).alias("concept"), "chrom", middle.alias("start"), (middle + 40).alias("stop"))
    signal = long.select("chrom", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("stop"), (F.col("seq_id") % 7).cast("double").alias("value"))
    consensus = stored(_consensus(spark, sf_dir), "consensus")

    def others(builder):
        return builder.add_regions(regions, genome, 64).add_tracks(tracks, signal, 64).add_synthetic_gc_like(0.5, control)

    return run_concepts(control, sequences.kmer_and_track_shares, network(68), consensus=consensus, others=others, insertions=(2, 6), components=COMPONENTS, per_concept=PER_CONCEPT)["scores"]


def _consensus(spark, sf_dir):
    """The letters of each whole text in stretches of 12, the last one where they end (or all of fewer), as variants of three motifs."""
    letters = F.upper(F.regexp_replace("text", "[^acgtACGT]", ""))
    whole = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("M"), (F.col("item_id") % 3).cast("string")).alias("motif"), letters.alias("letters")).filter("letters <> ''")
    stretches = F.array_union(F.regexp_extract_all("letters", F.lit(".{12}"), F.lit(0)), F.array(F.right("letters", F.lit(12))))
    return whole.select("motif", F.explode(stretches).alias("consensus")).distinct()


def network(inputs: int = 64, hidden: tuple[int, ...] = (32, 16), seed: int = 11) -> list[A.Dense]:
    rng, sizes = np.random.default_rng(seed), (inputs, *hidden, 1)
    return [A.Dense(rng.normal(size=(a, b)) / np.sqrt(a), rng.normal(size=b) * 0.1) for a, b in pairwise(sizes)]


def sequence_network(length: int = 64, seed: int = 12) -> list[A.Layer]:
    """Two convolutions, each with pooling (the second in overlapping windows), and two dense layers."""
    rng = np.random.default_rng(seed)
    sizes = [length - 4, (length - 4) // 4]
    last = sizes[1] - 2
    pooled = (last - 3) // 2 + 1
    return [
        A.Convolution(rng.normal(size=(8, 4, 5)) / 4, rng.normal(size=8) * 0.1, length), A.MaxPool(8, sizes[0], 4, 4),
        A.Convolution(rng.normal(size=(12, 8, 3)) / 4, rng.normal(size=12) * 0.1, sizes[1]), A.MaxPool(12, last, 3, 2),
        A.Dense(rng.normal(size=(12 * pooled, 16)) / 8, rng.normal(size=16) * 0.1), A.Dense(rng.normal(size=(16, 1)) / 4, rng.normal(size=1) * 0.1),
    ]


def _attributed(spark, sf_dir, model):
    rows = _vectors(spark, sf_dir)
    base = rows.filter("concept = '0'").select(F.array(*[F.avg(F.col("vector")[i].cast("double")) for i in range(len(model.mean))]).alias("base"))
    return A.layer_attributions(rows.crossJoin(F.broadcast(base)), network(), model)


def j8_mlp_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir, pca.fit(_vectors(spark, sf_dir), COMPONENTS)).select("id", "a")


def i7_cav_subspace(spark, sf_dir):
    """How much of a few directions' span each embedding lies in."""
    _, rows, cavs = _cavs(spark, sf_dir)
    found = cavs.collect()  # a row per concept
    if not found:
        return spark.createDataFrame([], "id long, share double")
    basis = pca.subspace(np.array([r.w for r in found]))
    inner = F.array(*[F.aggregate(F.zip_with("emb", F.array(*map(F.lit, q.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for q in basis.T])
    return rows.select("id", (F.aggregate(inner, F.lit(0.0), lambda s, x: s + x * x) / C.dot("emb", "emb")).alias("share"))


def k5_concept_run(spark, sf_dir):
    """From vectors to ranked concepts: components, embeddings, classifiers, attributions, log ratios."""
    model, _, cavs = _cavs(spark, sf_dir)
    found = C.scores(_attributed(spark, sf_dir, model), cavs).groupBy("concept").agg(F.sum((F.col("score") > 0).cast("long")).alias("n_pos"), F.sum((F.col("score") < 0).cast("long")).alias("n_neg"))
    return found.join(cavs.select("concept", "fscore"), "concept").select("concept", "n_pos", "n_neg", F.round(V.log_ratio(F.col("n_pos"), F.col("n_neg")), 6).alias("log_ratio"), "fscore")


L, AXES = f"l AS ({LONG_SQL})", f"ax AS (SELECT i AS pc, d, {uniform_sql(chr(39) + '6' + chr(39), 'i::VARCHAR', 'd::VARCHAR')} - 0.5::DOUBLE AS w FROM generate_series(0, {DIRECTIONS - 1}) a(i), generate_series(0, 63) b(d))"
S = "s AS (SELECT d, avg(v) AS mean, CASE WHEN stddev_samp(v) = 0 THEN -1.0 ELSE stddev_samp(v) END AS std FROM l GROUP BY d)"
ORACLE_SQL = {
    "e1_zscore_stats": f"WITH {L}, {S} SELECT d, round(mean, 6) AS mean, round(std, 6) AS std FROM s",
    "b14_zscores": f"WITH {L}, {S} SELECT vec_id, l.d, round((v - mean) / std, 6) AS z FROM l JOIN s ON l.d = s.d",
    "b15_destandardise": f"WITH {L} SELECT vec_id, round(sum(v), 5) AS total FROM l GROUP BY vec_id",
    "i6_restored": f"WITH {L} SELECT vec_id, count(*)::INT AS n, round(sum(v), 4) AS total FROM l GROUP BY vec_id",
    "e14_mean_directions": f"WITH {L} SELECT label, d, round(avg(v), 6) AS w FROM l GROUP BY label, d",
    "i9_centroid_cosine": f"WITH {L}, m AS (SELECT label, d, avg(v) AS v FROM l GROUP BY label, d), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label), p AS (SELECT x.label AS a, y.label AS b, sum(x.v * y.v) AS dot FROM m x JOIN m y ON x.d = y.d GROUP BY 1, 2) SELECT a, b, round(dot / (x.n * y.n), 6) AS cosine FROM p JOIN n x ON a = x.label JOIN n y ON b = y.label",
    "i8_direction_scores": f"WITH {L}, {AXES} SELECT pc AS concept, vec_id, round(sum(v * w), 6) AS score FROM l JOIN ax ON l.d = ax.d GROUP BY 1, 2",
    "i4_project": f"WITH {L}, {S}, {AXES} SELECT vec_id, pc, round(sum((v - mean) / std * w), 5) AS p FROM l JOIN s ON l.d = s.d JOIN ax ON l.d = ax.d GROUP BY 1, 2",
    "e15_mean_abs_corr": f"WITH {L}, p AS (SELECT x.d AS a, y.d AS b, corr(x.v, y.v) AS r FROM l x JOIN l y ON x.vec_id = y.vec_id AND x.d <> y.d GROUP BY 1, 2) SELECT round(avg(abs(r)), 6) AS mean_abs_corr FROM p",
    "j3_prepare_samples": """WITH k AS (SELECT vec_id AS id, label::VARCHAR AS concept FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', vec_id::VARCHAR))) <= 40),
      b AS (SELECT concept, id, 0 AS truth FROM k WHERE concept <> '0' UNION ALL SELECT n.concept, k.id, 1 FROM k, (SELECT DISTINCT concept FROM k WHERE concept <> '0') n WHERE k.concept = '0'),
      r AS (SELECT *, row_number() OVER (PARTITION BY concept, truth ORDER BY md5(concat_ws(':', '42', id::VARCHAR)), id) AS nth, count(*) OVER (PARTITION BY concept, truth) AS n FROM b)
      SELECT concept, truth, CASE WHEN nth <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY 1, 2, 3""",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "i3_pca_variance", "i5_embeddings", "j1_classifiers", "j2_adamw_classifiers", "j5_paired_controls", "j6_layer_output", "j7_patched_output", "j9_input_attributions", "e19_cluster_similarity", "k5_motif_run", "i10_cluster_order", "j8_mlp_attribution", "j8_sequence_attribution", "i1_leading_components", "i7_cav_subspace", "k5_concept_run", "k5_all_concepts"]}
