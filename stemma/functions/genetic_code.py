"""The genetic code and the tables that follow from it by rule."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The amino acids of code 11 in the order TTT, TTC, TTA, TTG, TCT, ... GGG; "*" stops.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
SENSE = [c for c, aa in CODE.items() if aa != "*"]


def table(spark: SparkSession) -> DataFrame:
    """(codon, aa, n_synonyms) of the 61 sense codons."""
    n = {aa: AMINO_ACIDS.count(aa) for aa in set(AMINO_ACIDS)}
    return spark.createDataFrame([(c, CODE[c], n[CODE[c]]) for c in SENSE], "codon string, aa string, n_synonyms int")


def code_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in CODE.items() for x in pair))


@lru_cache
def sites(codon: str) -> float:
    """Synonymous sites of a sense codon: its synonymous single changes, three to a site; a stop is none."""
    changed = (codon[:i] + b + codon[i + 1 :] for i in range(3) for b in BASES if b != codon[i])
    return sum(CODE[x] == CODE[codon] for x in changed) / 3


@lru_cache(5000)
def differences(one: str, other: str) -> tuple[float, float]:
    """Synonymous and other changes between two sense codons, averaged over the orders that meet no stop.

    If every order meets one, all differences count as not synonymous.
    """
    places = [i for i in range(3) if one[i] != other[i]]
    paths = []
    for order in permutations(places):
        now, same = one, 0
        for i in order:
            new = now[:i] + other[i] + now[i + 1 :]
            if CODE[new] == "*":
                break
            same += CODE[new] == CODE[now]
            now = new
        else:
            paths.append(same)
    if not paths:
        return 0.0, float(len(places))
    s = sum(paths) / len(paths)
    return s, len(places) - s


def pair_table(spark: SparkSession) -> DataFrame:
    """(x, y, sd, nd, s, n) for x <= y among the 61 sense codons: differences, and the mean sites of the two."""
    return spark.createDataFrame(pair_rows(), "x string, y string, sd double, nd double, s double, n double")


def pair_rows() -> list[tuple[str, str, float, float, float, float]]:
    rows = []
    for x in SENSE:
        for y in SENSE:
            if x <= y:
                s = (sites(x) + sites(y)) / 2
                rows.append((x, y, *differences(x, y), s, 3 - s))
    return rows
