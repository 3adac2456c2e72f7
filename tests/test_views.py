"""Views with bound arguments, sites in motifs, and selection within species."""

import os
import re

import pytest

from stemma.operators import conservation
from stemma.plans import panel, views

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_each_gene_answers_through_one_text(spark):
    views.register(spark, SF)
    whole = {(r.gene, r.species): r for r in views.ask(spark, "metric", metric="gc3", alpha=0.5).collect()}
    genes = sorted({g for g, _ in whole})
    assert len(genes) == 20
    for gene in (genes[0], genes[7], "none", "x' or '1'='1"):
        got = views.ask(spark, "metric", gene=gene, metric="gc3", alpha=0.5).collect()
        assert {(r.gene, r.species): r for r in got} == {k: r for k, r in whole.items() if k[0] == gene}
    less = {(r.gene, r.species): r.n_below for r in views.ask(spark, "metric", metric="gc3", alpha=0.4).collect()}
    assert all(less[k] <= whole[k].n_below for k in whole) and any(less[k] < whole[k].n_below for k in whole)


@needs_tables
def test_species_of_three_strains(spark):
    rows = panel.selection_within_species(spark, SF).collect()
    assert rows and all(r.n_sequences >= 3 for r in rows) and {r.species for r in rows} > {"en"}
    assert {r.control for r in rows} == {True, False} and sum(r.omega is not None for r in rows) > len(rows) / 2
    strict = {(r.gene, r.species): r for r in views.ask(spark, "selection", alpha=0.3).collect()} if views.register(spark, SF) is None else {}
    for r in rows:
        v = strict[r.gene, r.species]
        assert v.constrained == (r.omega is not None and r.omega < 0.3) and v.name == f"{r.gene} ({r.species})"


def test_sites_in_motifs_against_all_offsets(spark):
    seqs = {1: "MAAAKSLLGSSTG", 2: "AAA", 3: "SS", 4: "", 5: None, 6: "KAAAAAAR"}
    sites = [(3, "A", "pair", "AA"), (5, "K", "tail", "A+K|S.L"), (1, "M", "head", "^M"), (8, "L", "far", "K.{3}"), (7, "A", "odd", "AAA")]
    got = conservation.verified_sites(
        spark.createDataFrame(list(seqs.items()), "label int, seq string"), spark.createDataFrame(sites, "position int, expected string, motif string, pattern string"), around=2
    )
    want = {}
    for label, s in seqs.items():
        for position, expected, motif, pattern in sites:
            if s and position <= len(s):
                reach = [m for i in range(position) if (m := re.compile(f"(?:{pattern})").match(s[i:])) and i < position <= i + m.end()]
                want[label, position, motif] = (s[position - 1], s[position - 1] == expected, bool(reach), s[max(0, position - 3) : position + 2])
    assert {(r.label, r.position, r.motif): (r.observed, r.as_expected, r.in_motif, r.context) for r in got.collect()} == want
    assert {x[2] for x in want.values()} == {True, False}
