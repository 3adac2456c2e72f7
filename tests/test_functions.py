import math

import pytest
from pyspark.sql import functions as F

from stemma.functions import genetic_code, sequence


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())).select(expr.alias("r")).first().r


@pytest.mark.parametrize(("s", "want"), [("ATGAAATAA", ["ATG", "AAA"]), ("ATGAAAT", ["ATG", "AAA"]), ("ATGTAAAAA", ["ATG", "TAA", "AAA"]), ("ATGNNN", ["ATG"]), ("", [])])
def test_codons(spark, s, want):
    assert one(spark, sequence.codons_of(F.col("s")), s=s) == want


def test_composition_of_strings(spark):
    assert one(spark, sequence.gc_fraction(F.col("s")), s="GGCA") == 0.75
    assert one(spark, sequence.gc_fraction(F.col("s")), s="") is None
    assert one(spark, sequence.gc_skew(F.col("s")), s="GGGC") == 0.5
    assert one(spark, sequence.gc_at(F.col("s"), 3), s="AAGAAGAATG") == pytest.approx(2 / 3)
    assert one(spark, sequence.translated(F.col("s")), s="ATGTAANNNAA") == "M*X"
    assert sorted(one(spark, sequence.kmers(F.col("s"), 3), s="ABCDABC")) == ["ABC", "BCD", "CDA", "DAB"]
    assert one(spark, sequence.kmers(F.col("s"), 3), s="AB") == []


@pytest.mark.parametrize(("codon", "s"), [("ATG", 0), ("TTT", 1 / 3), ("GGG", 1)])
def test_sites(codon, s):
    assert genetic_code.sites(codon) == pytest.approx(s)


def test_differences():
    assert genetic_code.differences("TTT", "TTC") == (1, 0)
    assert genetic_code.differences("TTT", "TTA") == (0, 1)
    assert sum(genetic_code.differences("TTT", "CTC")) == 2
    assert len(genetic_code.SENSE) == 61


def test_distances(spark):
    assert one(spark, sequence.jukes_cantor(F.col("p")), p=0.0) == 0
    assert one(spark, sequence.jukes_cantor(F.col("p")), p=0.1) == pytest.approx(-0.75 * math.log(1 - 0.4 / 3))
    assert one(spark, sequence.jukes_cantor(F.col("p")), p=0.8) == 3
    assert one(spark, sequence.jukes_cantor(F.col("p"), None), p=0.8) is None
    want = -0.5 * math.log(1 - 0.2 - 0.05) - 0.25 * math.log(1 - 0.1)
    assert one(spark, sequence.kimura(F.col("p"), F.col("q")), p=0.1, q=0.05) == pytest.approx(want)


def test_proteins_of_whole_sequences(spark):
    from stemma.operators import composition

    rows = [(0, "ATGTAANNNAA"), (1, ""), (2, None), (3, "AC"), (4, "éTGTTTtttGGC\nAA"), (5, "".join(x + y + z for x in "TCAG" for y in "TCAG" for z in "TCAG"))]
    df = spark.createDataFrame(rows, "label bigint, nt string")
    got = {r.label: r.aa for r in composition.proteins(df, "label").collect()}
    assert got == {r.label: r.aa for r in df.select("label", sequence.translated(F.col("nt")).alias("aa")).collect()}
