"""Base, codon and amino-acid composition of sequences (label, gene, species, nt)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genetic_code, sequence

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: How letters of a text become bases, and aligned bases with gaps.
AS_BASES = "ACGTACGTACGTACGTACGTACGTAC"
AS_ALIGNED = "ACGTACGTA-GTACGT-CGTACG-AC"
_BASES = np.full(256, 255, np.uint8)
_BASES[[ord(c) for c in "TCAG"]] = range(4)


def sequences(docs: DataFrame) -> DataFrame:
    """Sequences from whole texts: each letter a base; the source is the gene and the language the species."""
    nt = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, AS_BASES)
    return docs.select(F.col("doc_id").alias("label"), F.col("source").alias("gene"), F.col("lang").alias("species"), nt.alias("nt"))


METRICS = ("length", "gc", "gc_skew", "gc1", "gc2", "gc3")


def _share(x: int, n: int) -> float | None:
    return x / n if n else None


def _measured(nt: str) -> tuple:
    """The figures of ``METRICS`` from one pass over a sequence; a last incomplete codon is no part of the last three."""
    x = np.frombuffer(nt.encode("latin-1", "replace"), np.uint8)
    g, c = x == ord("G"), x == ord("C")
    n_g, n_c, n = int(g.sum()), int(c.sum()), len(x) // 3
    places = (g | c)[: 3 * n].reshape(-1, 3).sum(axis=0).tolist()
    return len(x), _share(n_g + n_c, len(x)), _share(n_g - n_c, n_g + n_c), *(_share(k, n) for k in places)


def metrics(seqs: DataFrame) -> DataFrame:
    """(label, gene, species, length, gc, gc_skew, gc1, gc2, gc3): contents, null where there is nothing to count."""
    names = ("label", "gene", "species")
    kinds = ", ".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            rows = [(None,) * 6 if nt is None else _measured(nt) for nt in b.column("nt").to_pylist()]
            found = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int32(), *[pa.float64()] * 5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=[*names, *METRICS])

    return seqs.select(*names, "nt").mapInArrow(run, f"{kinds}, length int, gc double, gc_skew double, gc1 double, gc2 double, gc3 double")


def codon_table(seqs: DataFrame) -> DataFrame:
    """(label, gene, species, codon, n, first): a sequence's codons, as ``codons`` has them, with their numbers.

    ``first`` is 1 for the codon that the sequence begins with.  There are 64 rows a sequence at most.
    """
    names = ("label", "gene", "species")
    kinds = ", ".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in names)
    every = [x + y + z for x in "TCAG" for y in "TCAG" for z in "TCAG"]
    stops = [i for i, c in enumerate(every) if genetic_code.CODE[c] == "*"]

    def run(batches):
        for b in batches:
            at, codon, count, first = [], [], [], []
            for i, nt in enumerate(b.column("nt").to_pylist()):
                number = numbered(nt or "")
                if len(number) and number[-1] in stops:
                    number = number[:-1]
                number = number[number < 64]
                n = np.bincount(number, minlength=64)
                for k in np.flatnonzero(n).tolist():
                    at.append(i)
                    codon.append(every[k])
                    count.append(int(n[k]))
                    first.append(int(k == number[0]))
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in names), pa.array(codon, pa.string()), pa.array(count, pa.int64()), pa.array(first, pa.int64())], names=[*names, "codon", "n", "first"])

    return seqs.select(*names, "nt").mapInArrow(run, f"{kinds}, codon string, n bigint, first bigint")


def numbered(nt: str) -> np.ndarray:
    """The whole codons of a sequence as numbers, 16 a + 4 b + c of its bases in the order TCAG; 64 for one with another letter."""
    x = _BASES[np.frombuffer(nt.encode("latin-1", "replace"), np.uint8)]
    x = x[: len(x) // 3 * 3].reshape(-1, 3)
    return np.where((x < 4).all(axis=1), x.astype(np.int64) @ np.array([16, 4, 1]), 64)


_AMINO_ACIDS = np.frombuffer("".join(genetic_code.CODE[x + y + z] for x in "TCAG" for y in "TCAG" for z in "TCAG").encode() + b"X", np.uint8)


def proteins(seqs: DataFrame, *names: str, nt: str = "nt", aa: str = "aa") -> DataFrame:
    """(names, aa): what ``sequence.translated`` says of a sequence, looked up for all of its codons at once."""
    kinds = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches):
        for b in batches:
            for some in (b.slice(i, 1_000) for i in range(0, b.num_rows, 1_000)):
                found = [None if x.as_py() is None else _AMINO_ACIDS[numbered(x.as_py())].tobytes().decode("ascii") for x in some.column(nt)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(found, pa.string())], names=[*names, aa])

    return seqs.select(*names, nt).mapInArrow(run, f"{kinds}`{aa}` string")


def codons(seqs: DataFrame) -> DataFrame:
    """(label, gene, species, at, codon): the sense codons in order."""
    return seqs.select("label", "gene", "species", F.posexplode(sequence.codons_of(F.col("nt"))).alias("at", "codon"))


def codon_counts(seqs: DataFrame, *by: str) -> DataFrame:
    return codon_table(seqs).groupBy(*by, "codon").agg(F.sum("n").alias("n"))


def rscu(counts: DataFrame, *by: str, pseudocount: float = 0.0) -> DataFrame:
    """Relative synonymous codon usage of each sense codon: its count over the mean of its synonyms'."""
    code = F.broadcast(genetic_code.table(counts.sparkSession))
    groups = counts.select(*by).distinct() if by else None
    every = groups.join(code) if by else code
    joined = every.join(counts, [*by, "codon"], "left").withColumn("x", F.coalesce("n", F.lit(0)) + F.lit(pseudocount))
    total = F.sum("x").over(Window.partitionBy(*by, "aa"))
    return joined.select(*by, "codon", "aa", "n_synonyms", (F.col("x") * F.col("n_synonyms") / F.nullif(total, F.lit(0.0))).alias("rscu"))


def cai_weights(reference: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """Relative adaptiveness: RSCU over the best synonym's, for amino acids with two codons or more."""
    r = rscu(codon_counts(reference), pseudocount=pseudocount).filter("n_synonyms > 1")
    best = F.max("rscu").over(Window.partitionBy("aa"))
    return r.select("codon", "aa", (F.col("rscu") / best).alias("weight"))


def cai(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    """(label, cai): geometric mean of the weights of a sequence's codons after the first."""
    w = F.broadcast(weights.select("codon", "weight"))
    later = codon_table(seqs).withColumn("k", F.col("n") - F.col("first")).filter("k > 0").join(w, "codon")
    found = later.groupBy("label").agg(F.exp(F.sum(F.col("k") * F.ln("weight")) / F.sum("k")).alias("cai"))
    return seqs.select("label").join(found, "label", "left")


def amino_acid_composition(seqs: DataFrame) -> DataFrame:
    """(species, aa, fraction): means over sequences of each amino acid's share of the sequence."""
    aa = codon_table(seqs).join(F.broadcast(genetic_code.table(seqs.sparkSession)), "codon")
    per = aa.groupBy("species", "label", "aa").agg(F.sum("n").alias("n"))
    whole = per.groupBy("species", "label").agg(F.sum("n").alias("total"))
    size = whole.groupBy("species").agg(F.count("*").alias("n_seqs"))
    shares = per.join(whole, ["species", "label"]).groupBy("species", "aa").agg(F.sum(F.col("n") / F.col("total")).alias("s"))
    return shares.join(size, "species").select("species", "aa", (F.col("s") / F.col("n_seqs")).alias("fraction"))


def percentiles(values: DataFrame, group: str, value: str, places: int = 6) -> DataFrame:
    """``values`` with the percentage of its group that lies strictly below.

    Equal values, to ``places`` decimals, are counted before they are ordered, so
    that a window sees distinct values of a group and not its rows.
    """
    v = values.withColumn("__v", F.round(value, places))
    counts = v.groupBy(group, "__v").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(group).orderBy("__v")
    below = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy(group))
    table = counts.select(group, "__v", (100 * below / total).alias("percentile"))
    return v.join(table, [group, "__v"]).drop("__v")
