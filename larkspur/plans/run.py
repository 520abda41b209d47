"""A whole concept run over sequences: controls, concepts, components, directions, attributions, areas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.hashing import shuffle_key
from larkspur.functions.sequence import clean_motif_name, letter_count
from larkspur.operators import attribution as A
from larkspur.operators import classifiers as C
from larkspur.operators import metrics as X
from larkspur.operators import motifs as M
from larkspur.operators import pca
from larkspur.operators import vectors as V
from larkspur.operators.concepts import FITTED, ROLES, ConceptBuilder
from larkspur.operators.relational import first_n
from larkspur.plans.attributions import save_model
from larkspur.plans.report import write_report
from larkspur.sources.files import write_run
from larkspur.sources.storage import discard, stored

#: Concepts whose similarities are put in order.
LINKED = 2_000
#: Columns of the scores that a run gives.
SCORES = ("insertions", "concept", "fscore", "fscore_macro", "train_fscore", "n_pos", "n_neg", "log_ratio")


def run_concepts(
    control: DataFrame,
    activations: Callable[[DataFrame], DataFrame],
    layers: list[A.Layer],
    pwm: DataFrame | None = None,
    consensus: DataFrame | None = None,
    others: Callable[[ConceptBuilder], ConceptBuilder] | None = None,
    insertions: Sequence[int] = (4, 8, 16),
    control_kind: str = "random",
    components: int | None = 8,
    per_component: int | None = None,
    per_concept: int = 200,
    method: str = "l2",
    buffers: tuple[int, int] = (0, 0),
    seed: int = 1,
    similar_from: float = 0.9,
    path: str | None = None,
) -> dict[str, DataFrame]:
    """``scores`` by insertion count and concept, ``directions``, their ``similarity``, and ``areas`` under the F-scores per motif with its covariates.

    ``control`` has ``seq_id, seq``, any sequences. Motifs are matrices (``pwm``: ``motif, pos, a, c, g, t``), with their reverse complements, or ``consensus``
    strings (``motif, consensus``). ``others`` adds further concepts to a builder: regions, signal, synthetic GC content, sequences; they have 0
    insertions. ``activations`` turns ``seq`` (and ``track``) into ``vector`` and keeps other columns; the network after it is ``layers``. Classifiers are trained against
    the control, or with ``control_kind`` ``permuted`` motifs against their own with permuted places. One model of components is fitted on all
    concepts, with the most insertions, ``per_component`` samples of each (all if none is given). Attributions are those of the
    control's activations against the mean. ``similarity`` has concepts whose F-score is at least ``similar_from``. With ``path``, tables and a page are
    written there, and the model of components.
    """
    if control_kind not in ("random", "permuted"):
        raise ValueError("control_kind is random or permuted")
    permuted, counts = control_kind == "permuted", sorted(insertions)

    def built(n: int) -> ConceptBuilder:
        builder = ConceptBuilder(control, n, buffers, seed)
        builder = builder if pwm is None else builder.add_meme_motifs(pwm, permuted=permuted)
        return builder if consensus is None else builder.add_custom_motifs(consensus, permuted=permuted)

    builders = {n: built(n) for n in counts if pwm is not None or consensus is not None}
    if others is not None:
        builders[0] = others(ConceptBuilder(control, 0, buffers, seed))
    if not builders:
        raise ValueError("neither motifs nor other concepts")
    # Vectors that components are fitted on are stored whole, of others only those that classifiers draw.
    vectors = {n: stored(_vectors(builders[n], activations, FITTED), "vectors") for n in {max(builders), *([0] if 0 in builders else [])}}
    rows = reduce(lambda a, b: a.unionByName(b), vectors.values())
    if per_component is not None:
        rows = first_n(rows.withColumn("turn", shuffle_key(str(seed), F.col("concept"), F.col("seq_id"))), "concept", "turn", per_component)
    model = pca.fit(rows.select("id", "vector"), components)
    drawn = {n: stored(C.drawn(V.sound(_drawn_from(b, activations, vectors.get(n)), "vector", len(model.mean)), per_concept), "drawn") for n, b in builders.items()}
    signs_of = _attributed(next(iter(vectors.values())), layers, model)
    found, directions, every, used = [], [], [], [signs_of, *vectors.values(), *drawn.values()]
    for n, builder in builders.items():
        embedded = stored(pca.embed(drawn[n].select("id", "vector"), model).join(drawn[n].select("id", "concept"), "id"), "embedded")
        used.append(embedded)
        samples = _paired(builder, embedded, per_concept) if permuted and n else C.samples_for(embedded.filter(~F.col("concept").endswith("_permuted")), "control", per_concept)
        cavs = stored(C.train(samples, method), "directions")
        signs = X.sign_counts(C.scores(signs_of, cavs), "concept", median=False)
        found.append(cavs.join(signs, "concept").withColumn("insertions", F.lit(n)).withColumn("log_ratio", V.log_ratio(F.col("n_pos"), F.col("n_neg"))).select(*SCORES))
        every.append(cavs.select(F.lit(n).alias("insertions"), "concept", "w", "bias", "fscore"))
        directions.append(cavs.filter(F.col("fscore") >= similar_from).select(F.lit(n).alias("insertions"), "concept", "w"))
    scores = stored(reduce(lambda a, b: a.unionByName(b), found), "scores")
    similarity = reduce(lambda a, b: a.unionByName(b), [C.cosine(d.select("concept", "w")).select(F.lit(n).alias("insertions"), "a", "b", "cosine") for n, d in zip(builders, directions)])
    tables = {"scores": scores, "similarity": similarity}
    if len([n for n in builders if n]) > 1:
        tables["areas"], tables["trends"] = _areas(scores.filter("insertions > 0"), pwm, consensus)
    tables["directions"] = reduce(lambda a, b: a.unionByName(b), every)
    if path:
        save_model(control.sparkSession, model, f"{path}/model")
        write_run(path, tables)
        write_report(f"{path}/report", "Concepts", {k: v for k, v in tables.items() if k != "directions"})
    discard(*used)
    return tables


def _vectors(builder: ConceptBuilder, activations: Callable[[DataFrame], DataFrame], roles: Sequence[str] = ROLES) -> DataFrame:
    """``id, concept, seq_id, vector`` of all samples of a builder of these roles."""
    return activations(builder.everything(roles)).select(F.xxhash64("concept", "role", "seq_id").alias("id"), "concept", "seq_id", F.col("vector").cast("array<double>").alias("vector"))


def _drawn_from(builder: ConceptBuilder, activations: Callable[[DataFrame], DataFrame], fitted: DataFrame | None) -> DataFrame:
    """The same of all roles, of which classifiers draw; vectors that were stored to fit components aren't computed again."""
    if fitted is None:
        return _vectors(builder, activations)
    others = [r for r in ROLES if r not in FITTED]
    return fitted.unionByName(_vectors(builder, activations, others)) if any(x.role in others for x in builder.insertions) else fitted


def _attributed(vectors: DataFrame, layers: list[A.Layer], model: pca.Model) -> DataFrame:
    targets = vectors.filter("concept = 'control'").filter(F.size("vector") == len(model.mean)).withColumn("base", F.lit([float(x) for x in model.mean]))
    return stored(A.layer_attributions(targets.select("id", "vector", "base"), layers, model), "attributions")


def _paired(builder: ConceptBuilder, embedded: DataFrame, per_concept: int) -> DataFrame:
    pairs = [(x, f"{x}_permuted") for x in builder.motif_concepts()]
    return C.samples_for_pairs(embedded, embedded.sparkSession.createDataFrame(pairs, "concept string, control string"), per_concept)


def _areas(scores: DataFrame, pwm: DataFrame | None, consensus: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Areas with covariates of their motifs and the residual from the line on the last of these; and the lines on each, with R2 and p.

    Covariates of matrices are length, information and its part in G and C; of consensus strings the mean length and number of G and C.
    """
    parts, names = [], []
    if pwm is not None:
        parts.append(M.covariates(pwm).select(clean_motif_name(F.col("motif")).alias("concept"), F.col("len").cast("double").alias("len"), "ic", "ic_gc"))
        names = ["len", "ic", "ic_gc"]
    if consensus is not None:
        of = consensus.groupBy(clean_motif_name(F.col("motif")).alias("concept"))
        parts.append(of.agg(F.avg(F.length("consensus").cast("double")).alias("len"), F.avg(letter_count(F.upper("consensus"), "GC").cast("double")).alias("gc")))
        names = names or ["len", "gc"]
    covariates = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    areas = stored(X.trapezoid_area(scores, "concept", "insertions", "fscore").join(covariates, "concept").filter("area IS NOT NULL"), "areas")
    fitted = X.residuals(areas, names[-1], "area").orderBy(F.desc("residual"), "concept")
    lines = reduce(lambda a, b: a.unionByName(b), [X.line_fit(areas, c, "area", p_value=True).select(F.lit(c).alias("covariate"), "slope", "intercept", "r2", "p") for c in names])
    return fitted, lines


def similarity_order(similarity: DataFrame, scores: DataFrame) -> DataFrame:
    """``insertions, concept, place, log_ratio``: concepts of a run's ``similarity`` in the order of average linkage, with their log ratios of ``scores``.

    The matrices, concepts by concepts, are gathered; more than ``LINKED`` concepts of one insertion count are an error.
    """
    most = similarity.groupBy("insertions").agg(F.count_distinct("a").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > LINKED:
        raise ValueError(f"more than {LINKED} concepts")
    by_count: dict[int, dict[tuple[str, str], float]] = {}
    for r in similarity.collect():
        by_count.setdefault(r.insertions, {})[r.a, r.b] = r.cosine
    rows = []
    for n, cosines in by_count.items():
        names = sorted({a for a, _ in cosines})
        order = pca.average_linkage_order(np.array([[cosines[a, b] for b in names] for a in names]))
        rows += [(n, names[i], place) for place, i in enumerate(order)]
    placed = similarity.sparkSession.createDataFrame(rows, "insertions int, concept string, place int")
    return placed.join(scores.select("insertions", "concept", "log_ratio"), ["insertions", "concept"]).select("insertions", "concept", "place", "log_ratio")
