"""Atoms of PDB text by fixed columns, and B-factors written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(start: int, end: int) -> Column:
    return F.trim(F.substring("value", start, end - start + 1))


# The standard amino acids.
STANDARD = tuple("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split())
#: Their letters.
LETTERS = dict(zip(STANDARD, "ARNDCQEGHILKMFPSTWYV", strict=True))


def read(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """(record, serial, atom, residue, chain, number, x, y, z, b, line) of the ATOM and HETATM lines of a file's first model.

    A file is read whole by one task, as its models are told apart by the lines between.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)\A(.*?)(?:\nENDMDL|\z)", 1).alias("value"))
    lines = text.select(F.explode(F.split("value", "\r?\n")).alias("value")).filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    atoms = lines.select(
        _field(1, 6).alias("record"),
        _field(7, 11).cast("int").alias("serial"),
        _field(13, 16).alias("atom"),
        _field(18, 20).alias("residue"),
        _field(22, 22).alias("chain"),
        _field(23, 26).cast("int").alias("number"),
        *(_field(a, z).cast("double").alias(n) for n, a, z in (("x", 31, 38), ("y", 39, 46), ("z", 47, 54), ("b", 61, 66))),
        F.col("value").alias("line"),
    )
    return atoms if chain is None else atoms.filter(F.col("chain") == chain)


def first_available(spark: SparkSession, paths: list[str], chain: str | None = None) -> DataFrame:
    """The atoms of the first of ``paths``, in order of preference, that is there and has any."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            atoms = read(spark, path, chain)
            if not atoms.isEmpty():
                return atoms
    raise FileNotFoundError(f"no structure among {paths}")


def with_factors(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines whose B-factor is 100 times ``score`` of (number, score), or -1 for a residue without."""
    b = F.coalesce(F.round(100 * F.col("score"), 2), F.lit(-1.0))
    return atoms.join(scores, "number", "left").select("serial", F.overlay("line", F.format_string("%6.2f", b), F.lit(61), F.lit(6)).alias("line"))
