"""Column expressions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: channel order.
LETTERS = "ACGT"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def on_strand(seq: Column, strand: Column) -> Column:
    """The sequence as read on its strand."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def letter_count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def one_hot(seq: Column) -> Column:
    """Four channels (A, C, G, T) of 0 and 1 along the sequence; other letters are 0 in all."""
    letters = F.split(seq, "")
    channel = lambda base: F.transform(letters, lambda x: (x == base).cast("tinyint"))
    return F.array(*map(channel, LETTERS))


def is_clean(seq: Column) -> Column:
    """Neither empty nor with an unknown base."""
    return (F.length(seq) > 0) & ~F.contains(seq, F.lit("N"))


def clean_motif_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def overwrite(seq: Column, insert: Column, at: Column) -> Column:
    """``insert`` put over ``seq`` from the 0-based place ``at``, cut at the end of the sequence."""
    return F.substring(F.concat(F.substring(seq, F.lit(1), at), insert, F.substring(seq, at + F.length(insert) + 1, F.length(seq))), F.lit(1), F.length(seq))
