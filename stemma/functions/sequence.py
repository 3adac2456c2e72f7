"""Column expressions over nucleotide strings; all stay in the JVM and read a string once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .genetic_code import code_map


def count_of(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_fraction(s: Column) -> Column:
    """Share of G and C; null for an empty string."""
    return count_of(s, "GC") / F.nullif(F.length(s), F.lit(0))


def gc_skew(s: Column) -> Column:
    g, c = count_of(s, "G"), count_of(s, "C")
    return (g - c) / F.nullif(g + c, F.lit(0))


def whole_codons(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)..."), F.lit(0))


def gc_at(s: Column, position: int) -> Column:
    """GC fraction of the codons' first, second or third bases; a last incomplete codon is left out."""
    n = (F.length(s) / 3).cast("int") * 3
    taken = F.regexp_replace(F.substring(s, F.lit(1), n), "(?s)(.)(.)(.)", f"${position}")
    return gc_fraction(taken)


def codons_of(s: Column) -> Column:
    """Sense codons as an array: whole codons, without one stop at the end and without unknown ones; inner stops stay."""
    every = whole_codons(s)
    last = F.try_element_at(every, F.lit(-1))
    kept = F.when(F.try_element_at(code_map(), last) == "*", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)
    return F.filter(kept, lambda c: F.map_contains_key(code_map(), c))


def translated(s: Column) -> Column:
    """Amino acids of the whole codons, X where a codon is unknown."""
    return F.array_join(F.transform(whole_codons(s), lambda c: F.coalesce(F.try_element_at(code_map(), c), F.lit("X"))), "")


def kmers(s: Column, k: int) -> Column:
    """The distinct k-mers, from k passes of non-overlapping ones, so that time is linear in length."""
    shifted = (F.regexp_extract_all(F.substring(s, F.lit(i + 1), F.length(s)), F.lit("." * k), F.lit(0)) for i in range(k))
    return F.array_distinct(F.concat(*shifted))


def jukes_cantor(p: Column, most: float | None = 3.0) -> Column:
    """Distance of a share of differing sites; ``most`` where it is undefined (to rounding), or null."""
    arg = 1 - p * 4 / 3
    return F.when(arg > 1e-9, -0.75 * F.ln(arg) + 0.0).otherwise(F.lit(most).cast("double"))


def kimura(p: Column, q: Column, most: float = 3.0) -> Column:
    """Distance of the shares of transitions ``p`` and transversions ``q``."""
    a, b = 1 - 2 * p - q, 1 - 2 * q
    return F.when((a > 0) & (b > 0), 0.0 - 0.5 * F.ln(a) - 0.25 * F.ln(b)).otherwise(F.lit(most))
