"""Record checks: flags, inclusion, summary and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence

STARTS, STOPS = ("ATG", "GTG", "TTG"), ("TAA", "TAG", "TGA")
#: Flags that warn without excluding.
WARNINGS = ("extended",)


def flags(seqs: DataFrame, *, max_ambiguous: int = 0, shortest: float = 0.8, longest: float = 1.2) -> DataFrame:
    """Sequences with ``flags`` and ``included``; a gene's reference length is that of its first label."""
    nt, n = F.col("nt"), F.length("nt")
    reference = seqs.groupBy("gene").agg(F.min_by(F.length("nt"), "label").alias("ref_length"))
    ratio = n / F.nullif(F.col("ref_length"), F.lit(0))
    inner = F.substring(nt, F.lit(1), n - n % 3 - 3)
    found = [
        F.when(F.length(F.translate(nt, "ACGT", "")) > max_ambiguous, "ambiguous_bases"),
        F.when(n % 3 != 0, "length_not_multiple_of_3"),
        F.when(~F.substring(nt, 1, 3).isin(*STARTS), "no_start_codon"),
        F.when(~F.substring(nt, -3, 3).isin(*STOPS), "no_stop_codon"),
        F.when(F.exists(sequence.whole_codons(inner), lambda c: c.isin(*STOPS)), "internal_stop"),
        F.when(ratio < shortest, "truncated").when(ratio > longest, "extended"),
    ]
    marked = seqs.join(reference, "gene").withColumn("flags", F.array_compact(F.array(*found)))
    fatal = F.array_except("flags", F.array(*map(F.lit, WARNINGS)))
    return marked.withColumn("included", F.size(fatal) == 0)


def summary(flagged: DataFrame) -> DataFrame:
    n = F.length("nt")
    return flagged.groupBy("gene").agg(
        F.count("*").alias("n_found"),
        F.count_if("included").alias("n_included"),
        F.count_distinct(F.when(F.col("included"), F.col("species"))).alias("n_species"),
        F.median(n).alias("median_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
    )


def presence(flagged: DataFrame, genes: DataFrame, species: DataFrame) -> DataFrame:
    """(gene, species, state) for all of ``genes`` by all of ``species``: 2 included, 1 found, 0 absent."""
    state = flagged.groupBy("gene", "species").agg(F.max(F.when(F.col("included"), 2).otherwise(1)).alias("state"))
    return genes.join(F.broadcast(species)).join(state, ["gene", "species"], "left").fillna(0, ["state"])
