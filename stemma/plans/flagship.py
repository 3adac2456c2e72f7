"""The flagship query: from texts to codon adaptation by species, in built-in functions from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composition


def by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, n_sequences, gc, gc3, cai): means over all sequences; CAI weights come from the table itself."""
    seqs = composition.sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    m = composition.metrics(seqs).join(composition.cai(seqs, composition.cai_weights(seqs)), "label")
    return m.groupBy("species").agg(F.count("*").alias("n_sequences"), *(F.round(F.avg(c), 6).alias(c) for c in ("gc", "gc3", "cai")))
