"""Queries equal their SQL on the smallest test tables, where these are present."""

import itertools
import os

import duckdb
import numpy as np
import pytest

from stemma.operators import alignment, conservation, homology
from stemma.plans import catalogue, flagship, panel, views  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", catalogue.SQL)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Columns that the panel must fill, so that equal nulls or empty results prove nothing.
FILLED = {"panel_dnds_within": "omega", "panel_dnds_between": "omega", "panel_dnds_windows": "omega", "panel_dnds_bootstrap": "lo", "panel_gene_vs_controls": "p", "panel_window_intervals": "lo"}


@pytest.mark.parametrize("name", FILLED)
def test_panel_fills_what_it_estimates(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()[FILLED[name]]
    assert len(got) > 3 and got.notna().mean() > 0.7 and got.nunique() > 3


def test_panel_passes_checks(spark):
    got = catalogue.QUERIES["panel_qc_summary"](spark, SF).toPandas()
    assert (got["n_included"] > 0).all() and (got["n_included"] < got["n_found"]).any()
    assert (catalogue.QUERIES["gene_conservation_summary"](spark, SF).toPandas()["invariant_fraction"] > 0).all()


def test_simulated_tree_is_found(spark):
    assert {(r.grp, r.rf, r.nrf) for r in panel.topology_recovery(spark, SF).collect()} == {("codons", 0, 0.0), ("bases", 0, 0.0)}


def _plain_extraction(genomes):
    """Every gene of the reference in every other genome, searched and aligned one by one."""
    mers = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}

    def best(seq, among):
        """The best aligned of the five with most 3-mers in common; ties to the earlier."""
        found = sorted((-len(mers(seq) & mers(s)), t) for t, s in among.items())
        scored = [(t, *alignment.align(seq, among[t], alignment.Scoring(), local=True)) for n, t in found[:5] if n]
        return max(scored, key=lambda x: x[1], default=None)

    own, out = genomes[panel.REFERENCE], {}
    for genome, targets in genomes.items():
        for query, seq in own.items() if genome != panel.REFERENCE else ():
            if hit := best(seq, targets):
                target, score, ra, rb, _, _ = hit
                back = best(targets[target], own)
                covered = [len(r.replace("-", "")) / n for r, n in ((ra, len(seq)), (rb, len(targets[target])))]
                same = sum(x == y for x, y in zip(ra, rb, strict=True)) / len(ra)
                mutual = back is not None and back[0] == query
                why = [w for w, x in (("not reciprocal", not mutual), ("identity", same < 0.3), ("coverage", min(covered) < 0.6)) if x]
                out[genome, query] = (target, score, (same, *covered), mutual, ", ".join(why))
    return out


def test_panel_extraction_against_brute_force(spark):
    genomes = {}
    for r in panel._genomes(spark, SF).collect():
        genomes.setdefault(r.genome, {})[r.target] = r.seq
    want = _plain_extraction(genomes)
    got = panel.extract_panel(spark, SF).collect()
    figures = lambda r: pytest.approx((r.identity, r.query_coverage, r.target_coverage), abs=6e-5)
    assert {(r.genome, r.query): (r.target, r.score, figures(r), r.reciprocal_best_hit) for r in got} == {k: v[:-1] for k, v in want.items()}
    assert len(got) == len(want) and all(r.ortholog_call == (want[r.genome, r.query][-1] == "") for r in got)
    rejected = {(r.genome, r.query): r.reasons for r in panel.rejected_hits(spark, SF).collect()}
    assert rejected == {k: v[-1] for k, v in want.items() if v[-1]}
    assert {"coverage", "not reciprocal, coverage"} <= set(rejected.values()) and len(rejected) < len(want)
    # A record of another genome is found, and most are the same gene's.
    gene = {r.target: r.gene for r in panel._genomes(spark, SF).collect()}
    called = [r for r in got if r.ortholog_call]
    assert len(called) > 100 and all(gene[r.query] == gene[r.target] and r.query != r.target for r in called)


def test_family_extraction_against_brute_force(spark):
    every = {(r.genome, r.target): (r.gene, r.seq) for r in panel._genomes(spark, SF).collect()}
    queries = {t: s for (g, t), (gene, s) in every.items() if g == panel.REFERENCE and gene in panel.CONTROLS[:3]}
    like, seen = {}, set()
    for key, (_, seq) in sorted(every.items()):
        hits = {q: alignment.align(s, seq, alignment.Scoring(), local=True) for q, s in queries.items()}
        figures = {q: (x, sum(a == b for a, b in zip(ra, rb, strict=True)) / len(ra), len(ra.replace("-", "")) / len(queries[q]), len(rb.replace("-", "")) / len(seq)) for q, (x, ra, rb, _, _) in hits.items() if ra}
        if seq not in seen and any(f[1] >= 0.3 and min(f[2:]) >= 0.5 for f in figures.values()):
            seen.add(seq)
            best = min(figures, key=lambda q: (-figures[q][0], q))
            like[key] = (best, figures[best][0], figures[best][1])
    assert {(r.genome, r.target): (r["query"], r.score, pytest.approx(r.identity, abs=6e-5)) for r in panel.extract_family(spark, SF).collect()} == like


def test_family_of_equal_sequences_is_one(spark):
    seq = "MKTAYIAKQRWLEDNGVPSHMKTAYI"
    queries = spark.createDataFrame([(1, seq), (2, seq[:20])], "query bigint, seq string")
    targets = spark.createDataFrame([("b", 5, seq), ("a", 9, seq), ("a", 3, seq[1:]), ("c", 4, "GGGGGGGG")], "genome string, target bigint, seq string")
    got = homology.family(queries, targets).collect()
    assert {(r.genome, r.target, r["query"]) for r in got} == {("a", 9, 1), ("a", 3, 1)}


def test_motif_windows(spark):
    scores = conservation.conservation(panel._panel_rows(spark, SF)).toPandas()
    got = panel.motif_windows(spark, SF).toPandas()
    for gene, g in scores.groupby("gene"):
        c = dict(zip(g["col"], g["conservation"], strict=True))
        means = {e: round(sum(c[e - i] for i in range(7)) / 7, 9) for e in c if all(c.get(e - i) is not None and c.get(e - i) == c.get(e - i) for i in range(7))}
        left, want = sorted(means, key=lambda e: (-means[e], e)), []
        while left and len(want) < 6:
            want.append(left[0])
            left = [e for e in left if abs(e - want[-1]) >= 7]
        own = got[got["gene"] == gene].sort_values("rank")
        assert [round(x, 4) for x in own["mean_conservation"]] == [round(means[e], 4) for e in want]
        assert all(abs(a - b) >= 7 for a, b in itertools.combinations(own["end"], 2))


def test_conflicts_and_discordance(spark):
    rows, against = panel.discordance(spark, SF).toPandas(), panel.conflicts(spark, SF).toPandas()
    assert len(rows) and ((rows["n_splits"] + rows["n_reference"] - 2 * rows["n_shared"]) == rows["rf"]).all()
    assert rows["n_conflicts"].sum() == len(against) and (against["support"] >= 70).all() and (against["n_against"] >= 1).all()


def test_rank_correlation(spark):
    m = catalogue.sequence_metrics(spark, SF).select("gc", "gc3").toPandas().dropna()
    got = panel.spearman_test(spark, SF).toPandas().iloc[0]
    rho = m["gc"].rank().corr(m["gc3"].rank())
    assert abs(got["rho"] - rho) < 1e-6 and got["lo"] < rho < got["hi"] and 0 <= got["p"] < 0.05
    reps = [x["gc"].rank().corr(x["gc3"].rank()) for x in (m.sample(frac=1, replace=True, random_state=i) for i in range(300))]
    assert abs(np.quantile(reps, 0.025) - got["lo"]) < 0.05 and abs(np.quantile(reps, 0.975) - got["hi"]) < 0.05


def test_resampled_statistics(spark):
    v = catalogue._two_classes(spark, SF).toPandas().dropna()
    got = panel.resampled_statistics(spark, SF).toPandas().set_index("metric")
    rng = np.random.default_rng(1)
    for metric, g in v.groupby("metric"):
        a, b = (g[g["first"] == side]["value"].to_numpy() for side in (True, False))
        m, d = [], []
        for _ in range(1500):
            x, y = rng.choice(a, len(a)), rng.choice(b, len(b))
            m.append(np.median(x) - np.median(y))
            d.append(np.sign(x[:, None] - y[None, :]).mean())
        width = np.quantile(d, 0.975) - np.quantile(d, 0.025)
        assert abs(got.loc[metric, "delta_lo"] - np.quantile(d, 0.025)) < 0.2 * width and abs(got.loc[metric, "delta_hi"] - np.quantile(d, 0.975)) < 0.2 * width
        width = np.quantile(m, 0.975) - np.quantile(m, 0.025)
        assert abs(got.loc[metric, "median_lo"] - np.quantile(m, 0.025)) < 0.35 * width and abs(got.loc[metric, "median_hi"] - np.quantile(m, 0.975)) < 0.35 * width


def test_comparison_has_all_intervals(spark):
    for r in catalogue.effect_table(spark, SF).collect():
        assert r.delta_lo <= r.delta <= r.delta_hi and 0 <= r.p <= r.q <= 1
    for r in catalogue.group_comparison(spark, SF).collect():
        assert r.median_lo <= r.median_difference <= r.median_hi and r.lo <= r.difference <= r.hi


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert {r.species for r in flagship.by_species(spark, SF).collect()} == {"de", "en", "es", "fr"}


def test_first_of_equal_lines_is_the_first_of_the_table(spark, tmp_path):
    """The greater file is read first; among equal lines the one that stands first in the table counts all the same."""
    db, to = duckdb.connect(), tmp_path / "lineitem.parquet"
    to.mkdir()
    lines = "select {0} as l_orderkey, {1} as l_partkey, timestamp '2020-01-01' as l_shipdate, 1::integer as l_linenumber from range({2}) t(i)"
    for name, key, part, n in (("a", "i", "i + 500", 200), ("b", "i % 200", "i", 20_000)):
        db.sql(f"copy ({lines.format(key, part, n)}) to '{to}/{name}.parquet'")
    got = {r.l_orderkey: r.l_partkey for r in catalogue.first_by_coordinate(spark, str(tmp_path)).collect()}
    assert got == {i: i + 500 for i in range(200)}


def test_rows_meet_the_first_before_they_are_columns(spark):
    """The columns of a gene never meet in the task of a join."""
    plan = panel.running_places(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate posexplode") < plan.index("Join")


def test_first_lines_of_orders_with_unknown_fields(spark, tmp_path):
    """Lines without a part, a date or a number, as the SQL takes them."""
    db = duckdb.connect()
    lines = "(1, null, 1, 1), (1, 5, 2, 1), (2, null, 1, 1), (3, 7, null, 1), (3, 8, 1, 2), (4, 7, 1, null), (4, 8, 1, 2), (null, 3, 1, 1), (5, 9, null, null), (6, 1, null, null), (6, 2, null, 4)"
    day = "timestamp '2020-01-01' + to_days(d::integer)"
    db.sql(f"copy (select k::bigint as l_orderkey, p::bigint as l_partkey, {day} as l_shipdate, n::integer as l_linenumber from (values {lines}) t(k, p, d, n)) to '{tmp_path}/lineitem.parquet'")
    db.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = {tuple(r) for r in catalogue.first_by_coordinate(spark, str(tmp_path)).collect()}
    assert got == set(db.sql(catalogue.SQL["first_by_coordinate"]).fetchall()) and (1, 5) in got and (2, None) in got
