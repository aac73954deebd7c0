"""Generated DNA: random, repetitive and mutated texts, the same for the same seed on any cluster.

Letters come from a hash of (seed, text_id, place), not from a sequential generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import BASES


def _draw(*parts) -> Column:
    """A number in 0 to 2^31 - 1."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 31) - 1))


def random_dna(length: Column, seed: int, text_id: Column, salt: str = "") -> Column:
    """``length`` random bases."""
    base = lambda i: F.substring(F.lit(BASES), (_draw(F.lit(seed), F.lit(salt), text_id, i) % 4 + 1).cast("int"), F.lit(1))
    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), base), "")).otherwise("")


def periodic(motif: Column, length: Column) -> Column:
    """The motif over and over, cut to ``length``."""
    copies = F.ceil(length / F.greatest(F.length(motif), F.lit(1))).cast("int")
    return F.when(F.length(motif) > 0, F.substring(F.repeat(motif, copies), F.lit(1), length.cast("int"))).otherwise("")


def repeats(motif: Column, copies: int, share: float, seed: int, text_id: Column) -> Column:
    """``copies`` of the motif, then random padding so that the copies are ``share`` of the text."""
    if not 0 < share <= 1:
        raise ValueError("the repetitive share is above 0, at most 1")
    block = F.length(motif) * copies
    return F.concat(F.repeat(motif, copies), random_dna(F.floor(block / share + 0.5) - block, seed, text_id, "padding"))


def mutated(dna: Column, rate: float, seed: int, text_id: Column, strain: Column) -> Column:
    """dna with every place changed to another base with probability ``rate``."""

    def place(letter, i):
        at = F.instr(F.lit(BASES), letter) - 1
        other = (at + 1 + _draw(F.lit(seed), F.lit("to"), text_id, strain, i) % 3) % 4
        hit = _draw(F.lit(seed), F.lit("hit"), text_id, strain, i) < int(rate * (1 << 31))
        return F.when(hit, F.substring(F.lit(BASES), (other + 1).cast("int"), F.lit(1))).otherwise(letter)

    return F.when(F.length(dna) > 0, F.array_join(F.transform(F.split(dna, ""), place), "")).otherwise("")


def pangenome(texts: DataFrame, strains: int, divergence: float, seed: int = 42) -> DataFrame:
    """text_id, strain, dna: each text itself (strain 0) and strains - 1 mutants, each of the text."""
    each = texts.withColumn("strain", F.explode(F.sequence(F.lit(0), F.lit(strains - 1))))
    return each.select("text_id", "strain", F.when(F.col("strain") == 0, F.col("dna")).otherwise(mutated(F.col("dna"), divergence, seed, F.col("text_id"), F.col("strain"))).alias("dna"))
