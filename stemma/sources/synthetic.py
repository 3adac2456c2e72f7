"""Simulated sequences, to test estimates against known truth.

Codons and bases change along a tree by a continuous-time Markov chain: a branch
has one matrix of transition probabilities, and all sites of a sequence are drawn
from it at once.  A gene is a task of its own.  ``derived_panel`` makes related
sequences from a table's keys, with built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genetic_code import BASES, CODE, SENSE
from .newick import nodes

#: Sources by languages whose codons may be broadcast.
BROADCAST_KINDS = 10_000


def codon_rates(omega: float) -> np.ndarray:
    """Rates between the 61 sense codons: 1 for a single change that keeps the amino acid, omega for another.

    They are scaled so that a neutral codon (omega 1) changes three times in a time of 1, once for each of its bases.
    """
    single = np.array([[sum(a != b for a, b in zip(x, y, strict=True)) == 1 for y in SENSE] for x in SENSE])
    same = np.array([[CODE[x] == CODE[y] for y in SENSE] for x in SENSE])
    rates = np.where(single, np.where(same, 1.0, omega), 0.0) * 3 * len(SENSE) / single.sum()
    return rates - np.diag(rates.sum(1))


def probabilities(rates: np.ndarray, time: float) -> np.ndarray:
    """The matrix exponential of symmetric rates over a time."""
    values, vectors = np.linalg.eigh(rates)
    p = np.clip(vectors @ np.diag(np.exp(values * time)) @ vectors.T, 0.0, None)
    return p / p.sum(1, keepdims=True)


def base_probabilities(time: float) -> np.ndarray:
    """Four bases that all change into each other alike, once in a time of 1."""
    keep = np.exp(-4 * time / 3)
    return np.full((4, 4), (1 - keep) / 4) + np.eye(4) * keep


def drawn(states: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A new state for each state, from its row of ``p``."""
    return np.minimum((p.cumsum(1)[states] < rng.random(len(states))[:, None]).sum(1), len(p) - 1)


def along_tree(newick: str, root: np.ndarray, p_of: Callable[[float], np.ndarray], rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The states at the tree's tips, by name, when those at its root change along each branch."""
    found, states, parents = {}, {}, set()
    tree = nodes(newick)
    for node, parent, _, _, length in tree:
        states[node] = root if parent is None else drawn(states[parent], p_of(length or 0.0), rng)
        parents.add(parent)
    for node, _, name, _, _ in tree:
        if node not in parents:
            found[name] = states[node]
    return found


def star(taxa: int, length: float) -> str:
    return "(" + ",".join(f"taxon{i}:{length}" for i in range(taxa)) + ");"


def joined(lineages: list[tuple[str, float]], pause: float, rng: np.random.Generator) -> tuple[str, float]:
    """Lineages (text, age) joined two by two, backwards in time, until one is left.

    While k are left, the next two meet after a time of mean ``pause`` / k, half of it
    fixed and half of it exponential; which two is drawn.
    """
    now = max(age for _, age in lineages)
    while len(lineages) > 1:
        now += pause / len(lineages) * (0.5 + rng.exponential(0.5))
        pair = set(rng.choice(len(lineages), 2, replace=False).tolist())
        text = ",".join(f"{lineages[i][0]}:{now - lineages[i][1]:.6f}" for i in sorted(pair))
        lineages = [x for i, x in enumerate(lineages) if i not in pair] + [(f"({text})", now)]
    return lineages[0]


def species_tree(species: dict[str, list[str]], within: float = 0.2, between: float = 1.2, seed: int = 1) -> str:
    """A drawn tree in Newick's form: the strains of a species join first, then the species."""
    rng = np.random.default_rng(seed)
    clades = [joined([(strain, 0.0) for strain in strains], within, rng) for strains in species.values()]
    return joined(clades, between, rng)[0] + ";"


def _panel(spark: SparkSession, genes: int, of_gene: Callable[[int, np.random.Generator], tuple[dict[str, str], float | None]], seed: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for g in b.column("id").to_pylist():
                found, omega = of_gene(g, np.random.default_rng([seed, g]))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"gene{g}"] * n), pa.array([g * n + i for i in range(n)], pa.int64()), pa.array(list(found)),
                        pa.array(list(found.values())), pa.array([omega] * n, pa.float64()),
                    ],
                    names=["gene", "label", "species", "nt", "omega"],
                )

    return spark.range(0, genes, 1, genes).mapInArrow(run, "gene string, label bigint, species string, nt string, omega double")


def codon_panel(spark: SparkSession, newick: str, genes: int, n_codons: int, omegas: list[float], scale: float = 1.0, seed: int = 1) -> DataFrame:
    """(gene, label, species, nt, omega): codon sequences at a tree's tips; ``species`` is the tip's name."""

    def of_gene(g: int, rng: np.random.Generator):
        omega = omegas[g % len(omegas)]
        rates, known = codon_rates(omega), {}

        def p_of(length: float) -> np.ndarray:
            if length not in known:
                known[length] = probabilities(rates, length * scale)
            return known[length]

        tips = along_tree(newick, rng.integers(len(SENSE), size=n_codons), p_of, rng)
        return {name: "".join(SENSE[i] for i in states) for name, states in tips.items()}, omega

    return _panel(spark, genes, of_gene, seed)


def nucleotide_panel(spark: SparkSession, newick: str, genes: int, length: int, scale: float = 1.0, seed: int = 1) -> DataFrame:
    """As ``codon_panel``, of bases that change freely; omega is null."""

    def of_gene(g: int, rng: np.random.Generator):
        tips = along_tree(newick, rng.integers(4, size=length), lambda t: base_probabilities(t * scale), rng)
        return {name: "".join(BASES[i] for i in states) for name, states in tips.items()}, None

    return _panel(spark, genes, of_gene, seed)


def star_panel(spark: SparkSession, genes: int, taxa: int, n_codons: int, omegas: list[float], length: float = 0.05, seed: int = 1) -> DataFrame:
    return codon_panel(spark, star(taxa, length), genes, n_codons, omegas, seed=seed)


def _number(digest: Column, at: int) -> Column:
    """Eight hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def derived_panel(docs: DataFrame, n_codons: int = 100) -> DataFrame:
    """(label, gene, species, nt): a sequence for each row, from hashes of its doc_id, source and lang.

    A source has one row of codons, from ATG to TAA.  A language changes some third
    bases of it, a row some third and, a share that differs by source, some first or
    second ones; a change to a stop isn't made.  Rows numbered by multiples of 17,
    19, 23 and 29 have a record's usual faults: a lost base, another start, a stop
    inside, and the second half missing.
    """
    label, gene, species = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    sense = F.array(*map(F.lit, SENSE))

    def changed(codon: Column, when: Column, place: Column, base: Column) -> Column:
        left, right = F.substring(codon, F.lit(1), place - 1), F.substring(codon, place + 1, F.lit(3))
        new = F.concat(left, F.substring(F.lit(BASES), base + 1, F.lit(1)), right)
        return F.when(when & ~new.isin("TAA", "TAG", "TGA"), new).otherwise(codon)

    def of_gene(i: Column) -> Column:
        return F.element_at(sense, (_number(F.md5(F.concat_ws(":", gene, i.cast("string"))), 1) % len(SENSE) + 1).cast("int"))

    def with_digest(codons: Column, *key: Column) -> Column:
        """Each codon with the MD5 of its key, which is made once."""
        return F.transform(codons, lambda c, i: F.struct(c.alias("c"), F.md5(F.concat_ws(":", *key, (i + 1).cast("string"))).alias("h")))

    def of_species(x: Column) -> Column:
        return changed(x["c"], _number(x["h"], 1) % 100 < 6, F.lit(3), (_number(x["h"], 9) % 4).cast("int"))

    def of_row(x: Column) -> Column:
        place = F.when(_number(x["h"], 17) % 100 < F.col("__thirds"), 3).otherwise((1 + _number(x["h"], 17) % 2).cast("int"))
        return changed(x["c"], _number(x["h"], 1) % 100 < 8, place, (_number(x["h"], 9) % 4).cast("int"))

    # What a source and a language have in common is made once for both.
    codons = F.transform(F.sequence(F.lit(1), F.lit(n_codons - 2)), of_gene)
    own = F.transform(with_digest(codons, species, gene), of_species)
    kinds = docs.select("source", "lang").distinct()
    few = kinds.limit(BROADCAST_KINDS + 1).count() <= BROADCAST_KINDS
    common = kinds.select(gene.alias("__source"), species.alias("__lang"), own.alias("__codons"), (40 + _number(F.md5(gene), 1) % 50).alias("__thirds"))
    # The keys are short and what is made of them isn't: they are dealt out first, however few parts the table is read in.
    docs = docs.select("doc_id", "source", "lang").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    docs = docs.join(F.broadcast(common) if few else common, docs["source"].eqNullSafe(common["__source"]) & docs["lang"].eqNullSafe(common["__lang"]))
    inner = F.array_join(F.transform(with_digest(F.col("__codons"), label), of_row), "")
    d = F.col("doc_id")
    start = F.when(d % 19 == 0, "CTG").otherwise("ATG")
    held = F.when(d % 23 == 0, F.concat(F.substring(inner, 1, 12), F.lit("TAA"), F.substring(inner, 16, 3 * n_codons))).otherwise(inner)
    held = F.when(d % 29 == 0, F.substring(held, 1, n_codons // 2 * 3)).otherwise(held)
    whole = F.concat(start, held, F.lit("TAA"))
    nt = F.when(d % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    return docs.select(d.alias("label"), gene.alias("gene"), species.alias("species"), nt.alias("nt"))
