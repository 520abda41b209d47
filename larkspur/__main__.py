"""Work from files: ``python -m larkspur run|layer|inputs --genome g.fa --fai g.fa.fai --layers net.npz --out folder ...``.

``run`` trains directions of concepts: motifs of ``--motifs`` (MEME files) or ``--consensus``, and regions (``--regions``), signal (``--tracks`` with ``--bigwig``)
and synthetic GC content (``--gc-step``) beside them. Control regions are random windows of the genome, or those of ``--control``. With ``--bins`` or ``--edges``, there
is a run for each stretch of the window that motifs may lie in. ``layer`` and ``inputs`` attribute the regions of ``--targets`` against random windows, with the
components and directions of a run (``--trained``).

Activations are those of the network's first ``--upto`` layers on sequences; with ``--kmers``, shares of 3-letter strings (and of the track), which the whole network
then takes.
"""

from __future__ import annotations

import argparse
import sys
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import attribution as A
from larkspur.operators import intervals as I
from larkspur.operators import pca
from larkspur.operators import sequences as S
from larkspur.operators.concepts import ConceptBuilder
from larkspur.plans import attributions as T
from larkspur.plans.run import run_concepts
from larkspur.sources import bigwig, files
from larkspur.sources.storage import stored

COMMANDS = ("run", "layer", "inputs")


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    given = list(sys.argv[1:] if arguments is None else arguments)
    p = argparse.ArgumentParser(prog="larkspur")
    commands = p.add_subparsers(dest="command", required=True)
    run, layer, inputs = (commands.add_parser(name) for name in COMMANDS)
    for each in (run, layer, inputs):
        for name in ("genome", "fai", "layers", "out"):
            each.add_argument(f"--{name}", required=True)
        each.add_argument("--window", type=int, default=1024)
        each.add_argument("--upto", type=int, default=1, help="layers below the components")
        each.add_argument("--seed", type=int, default=1)
    run.add_argument("--motifs", nargs="+", help="MEME files")
    run.add_argument("--consensus", nargs="+", help="files of names and consensus strings")
    run.add_argument("--control", help="a BED file of control regions")
    run.add_argument("--control-kind", choices=("random", "permuted"), default="random")
    run.add_argument("--regions", help="a BED file of five columns, the last a concept: its sequences")
    run.add_argument("--tracks", help="the same, for its signal")
    run.add_argument("--bigwig", help="the signal, a bigWig file or folder")
    run.add_argument("--gc-step", type=float)
    run.add_argument("--samples", type=int, default=1000, help="control regions drawn, and samples of a concept for its classifier")
    run.add_argument("--component-samples", type=int, help="samples of a concept that components are fitted on")
    run.add_argument("--insertions", type=int, nargs="+", default=[4, 8, 16])
    run.add_argument("--components", type=int, default=8)
    run.add_argument("--method", choices=("l2", "l1", "adamw"), default="l2")
    run.add_argument("--kmers", action="store_true")
    where = run.add_mutually_exclusive_group()
    where.add_argument("--bins", type=int, help="equal parts of the window")
    where.add_argument("--edges", type=int, nargs="+", help="bounds of its parts")
    for each in (layer, inputs):
        each.add_argument("--targets", required=True, help="a BED file")
        each.add_argument("--chroms", nargs="+")
        each.add_argument("--trained", required=True, help="the folder of a run")
        each.add_argument("--baselines", type=int, default=10, help="random windows for each region")
    layer.add_argument("--multipliers", action="store_true", help="not times the difference of region and baseline")
    inputs.add_argument("--concepts", nargs="+", help="those whose directions count; all if none are named")
    inputs.add_argument("--least-fscore", type=float, default=0.0)
    return p.parse_args(given if given and given[0] in (*COMMANDS, "-h", "--help") else ["run", *given])


def buffers(a: argparse.Namespace) -> dict[str, tuple[int, int]]:
    """Where motifs may lie, as bases left free on both sides, by the name of the run."""
    if a.bins:
        found = I.position_bins(a.window, a.bins)
    elif a.edges:
        found = [(low, a.window - high) for low, high in pairwise(sorted(a.edges))]
    else:
        return {"whole": (0, 0)}
    return {f"from{low}to{a.window - high}": (low, high) for low, high in found}


def control_sequences(spark: SparkSession, a: argparse.Namespace, genome: DataFrame) -> DataFrame:
    if not a.control:
        return ConceptBuilder.from_genome(files.read_chrom_sizes(spark, a.fai), genome, a.window, a.samples, a.seed).control
    regions = I.center_regions(files.read_tsv(spark, a.control, files.BED3), a.window).distinct()
    return stored(S.region_sequences(regions, genome).select(F.xxhash64("chrom", "start").alias("seq_id"), "seq"), "control")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    genome, layers = files.read_indexed_fasta(spark, a.genome, a.fai), A.load_layers(spark, a.layers)
    control = control_sequences(spark, a, genome)
    pwm = files.read_meme_files(spark, a.motifs) if a.motifs else None
    consensus = files.read_consensus(spark, a.consensus) if a.consensus else None

    def others(builder: ConceptBuilder) -> ConceptBuilder:
        if a.regions:
            builder.add_regions(files.read_tsv(spark, a.regions, files.BED5), genome, a.window)
        if a.tracks:
            builder.add_tracks(files.read_tsv(spark, a.tracks, files.BED5), bigwig.read_bigwig(spark, a.bigwig), a.window)
        return builder if a.gc_step is None else builder.add_synthetic_gc(a.gc_step, a.samples, a.window)

    def of_layers(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("id", F.xxhash64("concept", "role", "seq_id"))
        return keyed.select("id", "concept", "role", "seq_id").join(A.layer_output(keyed.select("id", "seq"), layers, a.upto), "id")

    of_kmers = S.kmer_and_track_shares if a.tracks else lambda rows: S.kmer_shares(rows.drop("track"))
    for name, free in buffers(a).items():
        run_concepts(
            control, of_kmers if a.kmers else of_layers, layers if a.kmers else layers[a.upto :], pwm, consensus,
            others if a.regions or a.tracks or a.gc_step is not None else None, a.insertions, a.control_kind, a.components, a.component_samples,
            a.samples, a.method, free, a.seed, path=f"{a.out}/{name}")


def _attributed(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Target regions with ``id``, their sequences, and those of random windows."""
    regions = I.center_regions(files.read_tsv(spark, a.targets, files.BED3).distinct(), a.window)
    regions = stored((I.keep_chromosomes(regions, a.chroms) if a.chroms else regions).withColumn("id", F.xxhash64("chrom", "start")), "targets")
    records = files.read_tsv(spark, a.fai, files.FAI).withColumn("file", F.lit(a.genome))
    targets = stored(files.read_fasta_regions(regions, records).select("id", "seq"), "sequences")
    windows = I.random_regions(records.select("chrom", "length"), a.window, max(1, targets.count() * a.baselines), f"{a.seed}:baseline")
    pool = files.read_fasta_regions(windows, records).select(F.col("region_id").alias("id"), "seq")
    return regions, targets, stored(S.drop_unclean(pool), "baselines")


def layer(spark: SparkSession, a: argparse.Namespace) -> None:
    regions, targets, pool = _attributed(spark, a)
    tables = T.layer_run(targets, pool, A.load_layers(spark, a.layers), a.upto, T.load_model(spark, f"{a.trained}/model"), a.baselines, not a.multipliers)
    files.write_tsv(regions.join(targets.select("id"), "id", "left_semi").select("chrom", "start", "stop"), f"{a.out}/regions")
    files.write_run(a.out, tables)


def inputs(spark: SparkSession, a: argparse.Namespace) -> None:
    regions, targets, pool = _attributed(spark, a)
    held = files.read_run(spark, a.trained, ["directions"])["directions"].filter(F.col("fscore") >= a.least_fscore)
    chosen = held.filter(F.col("concept").isin(a.concepts)) if a.concepts else held
    directions = np.array([r.w for r in chosen.orderBy("insertions", "concept").collect()])  # a row per concept
    if not len(directions):
        raise ValueError("no direction is chosen")
    found = T.input_run(targets, pool, A.load_layers(spark, a.layers), a.upto, T.load_model(spark, f"{a.trained}/model"), pca.subspace(directions), a.baselines)
    T.write_inputs(regions, stored(found, "attributions"), a.out, files.read_chrom_sizes(spark, a.fai))


def main(arguments: list[str] | None = None) -> None:
    a = parsed(arguments)
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    {"run": run, "layer": layer, "inputs": inputs}[a.command](spark, a)


if __name__ == "__main__":
    main()
