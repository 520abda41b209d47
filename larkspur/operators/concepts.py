"""Concept builder: one lazy table of samples, tagged by concept and role."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import motifs as M
from larkspur.operators import sequences as S
from larkspur.operators.intervals import center_regions, keep_frequent, random_regions, track_values
from larkspur.operators.relational import numbered
from larkspur.sources.storage import stored

ROLES = ("test", "control", "permuted")
#: Roles that components are fitted on.
FITTED = ("test", "control")


@dataclass
class ConceptBuilder:
    """Collects ``concept, role, seq_id, seq``. Adding never changes what was given.

    ``control`` has ``seq_id, seq``; motif concepts are the control's sequences with motifs put in. Motifs are kept as matrices, and the sequences
    of all of them are made in one pass over the control, so a plan has one branch for motifs whatever their number.
    """

    control: DataFrame
    motifs_per_sequence: int = 1
    buffers: tuple[int, int] = (0, 0)
    seed: int = 1
    least: int = 1
    parts: list[DataFrame] = field(default_factory=list)
    tracks: list[DataFrame] = field(default_factory=list)
    insertions: list[S.Insertion] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.parts.append(self._tagged(S.drop_unclean(self.control), "control", "control"))

    def _tagged(self, rows: DataFrame, concept: str, role: str) -> DataFrame:
        return rows.select(F.lit(concept).alias("concept"), F.lit(role).alias("role"), F.col("seq_id").cast("long").alias("seq_id"), "seq")

    @classmethod
    def from_genome(cls, sizes: DataFrame, genome: DataFrame, window: int, n: int, seed: int = 1, **kept) -> "ConceptBuilder":
        """With a control of ``n`` random windows of the genome; those with unknown bases are left out."""
        regions = random_regions(sizes, window, n, f"{seed}:control")
        control = S.region_sequences(regions, genome).select(F.col("region_id").alias("seq_id"), "seq")
        return cls(stored(control, "control"), seed=seed, **kept)

    def add_motif(self, name: str, matrix: np.ndarray | Sequence[np.ndarray], permuted: bool = False) -> "ConceptBuilder":
        """A concept of a position probability matrix or of several variants, and if asked its control with the positions permuted."""
        name = name.replace("/", "-")
        variants = [np.asarray(m, float) for m in ([matrix] if np.ndim(matrix[0][0]) == 0 else matrix)]
        pairs = [(name, "test", variants)]
        if permuted:
            rng = S.seeded(self.seed, name)
            pairs.append((f"{name}_permuted", "permuted", [M.permuted_matrix(m, rng) for m in variants]))
        self.insertions += [S.Insertion(concept, role, each) for concept, role, each in pairs]
        return self

    def add_meme_motifs(self, pwm: DataFrame, names: Sequence[str] | None = None, reverse: bool = True, permuted: bool = False) -> "ConceptBuilder":
        """A concept for each motif of ``motif, pos, a, c, g, t``, or the named ones, with its reverse complement if asked."""
        for name, matrix in sorted(M.matrices(pwm if names is None else pwm.filter(F.col("motif").isin(list(names)))).items()):
            self.add_motif(name, [matrix, matrix[::-1, ::-1]] if reverse else [matrix], permuted)
        return self

    def add_custom_motifs(self, consensus: DataFrame, reverse: bool = True, permuted: bool = False) -> "ConceptBuilder":
        """A concept for each name of ``motif, consensus``; its consensus strings are the variants."""
        both = M.with_reverse_complements(consensus) if reverse else consensus
        rows = both.groupBy("motif").agg(F.array_sort(F.collect_set(F.upper("consensus"))).alias("variants")).limit(M.MOTIFS + 1).collect()
        if len(rows) > M.MOTIFS:
            raise ValueError(f"more than {M.MOTIFS} motifs")
        for r in sorted(rows):
            self.add_motif(r.motif, [M.consensus_matrix(x) for x in r.variants], permuted)
        return self

    def add_regions(self, regions: DataFrame, genome: DataFrame, window: int) -> "ConceptBuilder":
        """Concepts of regions ``concept, chrom, start, stop`` and perhaps ``strand``: the genome's sequences in windows around their middles."""
        centred = center_regions(regions.select(*[c for c in ("concept", "chrom", "start", "stop", "strand") if c in regions.columns]).distinct(), window)
        found = S.region_sequences(centred, genome)
        return self.add_sequences(found.withColumn("seq_id", F.xxhash64("chrom", "start")))

    def add_tracks(self, regions: DataFrame, signal: DataFrame, window: int) -> "ConceptBuilder":
        """Concepts of signal: the control's sequences, each with the ``track`` of one of the concept's regions, paired in order.

        Pairs end with the shorter side; concepts with too few regions are left out.
        """
        kept = keep_frequent(center_regions(regions.select("concept", "chrom", "start", "stop").distinct(), window).filter("start >= 0"), "concept", self.least)
        tracks = numbered(track_values(kept, signal), "chrom", "start", by=["concept"]).select("concept", "ordinal", "track")
        control = numbered(S.drop_unclean(self.control).select(F.col("seq_id").cast("long").alias("seq_id"), "seq"), "seq_id")
        self.tracks.append(control.join(tracks, "ordinal").select("concept", F.lit("test").alias("role"), "seq_id", "seq", "track"))
        return self

    def apply_transform(self, transform: Callable[[DataFrame], DataFrame]) -> "ConceptBuilder":
        """A function of DataFrames over all samples so far; it keeps the columns ``concept, role, seq_id, seq``."""
        self.parts, self.insertions = [transform(self.samples())], []
        return self

    def add_sequences(self, rows: DataFrame) -> "ConceptBuilder":
        """Concepts of ``concept, seq_id, seq``; those with too few clean samples are left out."""
        kept = keep_frequent(S.drop_unclean(rows), "concept", self.least)
        self.parts.append(kept.select("concept", F.lit("test").alias("role"), F.col("seq_id").cast("long").alias("seq_id"), "seq"))
        return self

    def add_synthetic_gc(self, step: float, n: int, length: int) -> "ConceptBuilder":
        """Concepts of ``n`` sequences each, from no G and C to nothing else."""
        return self.add_synthetic_gc_like(step, self.control.sparkSession.range(n).select(F.col("id").alias("seq_id"), F.lit(length).alias("length")))

    def add_synthetic_gc_like(self, step: float, rows: DataFrame) -> "ConceptBuilder":
        """The same, with a sequence for each row of ``seq_id`` and ``length`` (or ``seq``, whose length it is)."""
        sizes = rows.select("seq_id", (F.col("length") if "length" in rows.columns else F.length("seq")).alias("length"))
        made = S.with_synthetic_gc(sizes, {f"synthetic_gc_{gc:.2f}": gc for gc in S.gc_grid(step)}, self.seed)
        self.parts.append(made.select("concept", F.lit("test").alias("role"), "seq_id", "seq"))
        return self

    def motif_samples(self, roles: Sequence[str] = ROLES) -> DataFrame:
        """``concept, role, seq_id, seq`` of all motif concepts of these roles, in one pass over the control."""
        return S.with_insertions(S.drop_unclean(self.control), [x for x in self.insertions if x.role in roles], self.motifs_per_sequence, *self.buffers, self.seed)

    def motif_concepts(self) -> list[str]:
        return [x.concept for x in self.insertions if x.role == "test"]

    def samples(self, roles: Sequence[str] = ROLES) -> DataFrame:
        others = [r for r in ROLES if r not in roles]
        given = [p.filter(~F.col("role").isin(others)) for p in self.parts] if others else self.parts
        return reduce(lambda a, b: a.unionByName(b), [*given, *([self.motif_samples(roles)] if any(x.role in roles for x in self.insertions) else [])])

    def paired_tracks(self) -> DataFrame:
        """``concept, role, seq_id, seq, track`` of the concepts of signal."""
        return reduce(lambda a, b: a.unionByName(b), self.tracks)

    def everything(self, roles: Sequence[str] = ROLES) -> DataFrame:
        """``concept, role, seq_id, seq, track`` of all concepts of these roles; only those of signal have a track."""
        tracks = self.tracks if "test" in roles else []
        return reduce(lambda a, b: a.unionByName(b), [self.samples(roles).withColumn("track", F.lit(None).cast("array<double>")), *tracks])

    def for_components(self) -> DataFrame:
        return self.samples(FITTED)

    def summary(self) -> DataFrame:
        return self.samples().groupBy("concept", "role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("seq")).alias("mean_length"))
