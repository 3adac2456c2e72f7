"""Queries on a panel of related sequences, and further views of the tables.

The panel is made from the keys of ``documents`` by hashes, in Spark and in SQL
alike, so that omegas are finite, records pass their checks and columns are
conserved, which sequences made from the letters of texts are not.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genetic_code, sequence
from ..operators import alignment, composition, conservation, distances, families, homology, quality, selection, statistics, structure, tables, trees
from ..operators.lineage import written
from ..sources import newick, synthetic
from ..sources import structure as pdb
from .catalogue import (
    _METRICS, CELLS, CODON_COLS, CODONS, COLS, CONSENSUS, DISTANT, ESTIMATE, FLAGGED, HENIKOFF, PROTEINS, QUERIES, ROWS, RSCU, SEQS, SQL, UTEST, WEIGHT, WITHIN,
    _distant, _items, _points, _proteins, _rounded, _rows, _seqs, _table, _two_classes, dnds_between, dnds_windows, dnds_within, presence_matrix, qc_flags, qc_summary,
    query, sequence_metrics,
)

CONTROLS = ["src0", "src1", "src2", "src3"]
N = 100
_NUM = "('0x' || substring(md5({0}), {1}, 8))::bigint"


def _changed(when: str, place: str, base: str) -> str:
    new = f"c[1:{place} - 1] || 'TCAG'[{base} + 1] || c[{place} + 1:3]"
    return f"case when {when} and {new} not in ('TAA', 'TAG', 'TGA') then {new} else c end"


_SPECIES, _ROW, _GENE = "concat_ws(':', lang, source, i::varchar)", "concat_ws(':', doc_id::varchar, i::varchar)", "concat_ws(':', source, i::varchar)"
_PLACE = f"(case when {_NUM.format(_ROW, 17)} % 100 < 40 + {_NUM.format('source', 1)} % 50 then 3 else 1 + {_NUM.format(_ROW, 17)} % 2 end)"
PANEL = f"""panel_own as (
  select doc_id, source, lang, list_transform(range(1, {N - 1}), lambda i: {genetic_code.SENSE}[{_NUM.format(_GENE, 1)} % 61 + 1]) as cs from documents
), panel_species as (
  select doc_id, source, lang, list_transform(cs, lambda c, i: {_changed(f"{_NUM.format(_SPECIES, 1)} % 100 < 6", "3", f"{_NUM.format(_SPECIES, 9)} % 4")}) as cs from panel_own
), panel_rows as (
  select doc_id, source, lang, array_to_string(list_transform(cs, lambda c, i: {_changed(f"{_NUM.format(_ROW, 1)} % 100 < 8", _PLACE, f"{_NUM.format(_ROW, 9)} % 4")}), '') as x from panel_species
), panel_held as (
  select doc_id, source, lang, case when doc_id % 23 = 0 then x[1:12] || 'TAA' || x[16:] else x end as x from panel_rows
), panel_whole as (
  select doc_id, source, lang, case when doc_id % 19 = 0 then 'CTG' else 'ATG' end || case when doc_id % 29 = 0 then x[1:{N // 2 * 3}] else x end || 'TAA' as x from panel_held
), seqs as (
  select doc_id as label, source as gene, lang as species, case when doc_id % 17 = 0 then x[1:length(x) - 1] else x end as nt from panel_whole
)"""
PANEL_ROWS = f"{PANEL}, rws as (select gene, label, species, nt as r from seqs)"


def _panel(spark, sf_dir):
    """Short rows, read several times by a query and by all queries alike: kept in memory or on the executors' disks."""
    return synthetic.derived_panel(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), N).persist()


def _panel_rows(spark, sf_dir):
    return _panel(spark, sf_dir).withColumnRenamed("nt", "row")


def _on_panel(sql: str) -> str:
    return sql.replace(ROWS, PANEL_ROWS).replace(SEQS, PANEL)


@query(f"with {PANEL} select label, gene, species, nt from seqs")
def panel_sequences(spark, sf_dir):
    return _panel(spark, sf_dir)


for _f in (qc_flags, qc_summary, presence_matrix, dnds_within, dnds_between, dnds_windows):
    QUERIES[f"panel_{_f.__name__}"] = partial(_f, seqs=_panel)
    SQL[f"panel_{_f.__name__}"] = _on_panel(SQL[_f.__name__])


# --- selection ---------------------------------------------------------------------------------

REPLICATES, WINDOW_REPLICATES = 1000, 200


def _totals(spark, sf_dir):
    return selection.within_columns(_panel(spark, sf_dir), "gene")


def _replicated(sql: str, replicates: int) -> str:
    return sql.replace("range(1, 51)", f"range(1, {replicates + 1})").replace(">= 25", f">= {replicates // 2}")


SQL["panel_dnds_bootstrap"] = _replicated(_on_panel(SQL["dnds_bootstrap"]), REPLICATES)
SQL["panel_gene_vs_controls"] = _replicated(_on_panel(SQL["gene_vs_controls"]), REPLICATES)


@query(SQL["panel_dnds_bootstrap"])
def panel_dnds_bootstrap(spark, sf_dir):
    return _rounded(selection.bootstrap(_totals(spark, sf_dir), ["gene"], REPLICATES), 4, "lo", "hi")


@query(SQL["panel_gene_vs_controls"])
def panel_gene_vs_controls(spark, sf_dir):
    return _rounded(_rounded(selection.against_controls(_totals(spark, sf_dir), "gene", CONTROLS, REPLICATES), 4, "lo", "hi"), 6, "p")


_IN_WINDOWS = f"""{WITHIN}, ends as (select gene, max(col) + 1 as length from totals group by gene),
spread as (select t.*, s.start from totals t join ends using (gene), lateral (select unnest(range(0, t.col + 1, 20)) as start) s
  where t.col < s.start + 60 and (s.start = 0 or s.start + 60 <= length))"""
_OMEGA = """select {0}, case when ds > 0 then dn / ds end as omega from (
  select {0}, case when ps < 0.749999999 then 0.0::double - 0.75::double * ln(1 - ps * 4 / 3) end as ds, case when pn < 0.749999999 then 0.0::double - 0.75::double * ln(1 - pn * 4 / 3) end as dn
  from (select {0}, sum(sd) / nullif(sum(s), 0) as ps, sum(nd) / nullif(sum(n), 0) as pn from {1} group by {0}))"""


@query(
    _on_panel(
        f"""with {_IN_WINDOWS}, drawn as (select gene, start, rep, sd * w as sd, nd * w as nd, s * w as s, n * w as n
      from (select *, {WEIGHT.format("rep || ':' || col")} as w from spread, range(1, {WINDOW_REPLICATES + 1}) t(rep)) where w > 0),
    est as ({_OMEGA.format("gene, start, rep", "drawn")})
    select gene, start::int as start, case when count(omega) >= {WINDOW_REPLICATES // 2} then round(quantile_cont(omega, 0.025), 4) end as lo,
      case when count(omega) >= {WINDOW_REPLICATES // 2} then round(quantile_cont(omega, 0.975), 4) end as hi, count(omega) as n_finite from est group by gene, start"""
    )
)
def panel_window_intervals(spark, sf_dir):
    """Bootstrap intervals of the sliding windows' omega."""
    spread = selection.in_windows(_totals(spark, sf_dir), ["gene"])
    return _rounded(selection.bootstrap(spread, ["gene", "start"], WINDOW_REPLICATES), 4, "lo", "hi")


@query(_on_panel(f"with {WITHIN} select gene, round(sum(sd), 3) as sd, round(sum(nd), 3) as nd, round(sum(s), 3) as s, round(sum(n), 3) as n from totals group by gene"))
def panel_dnds_sums(spark, sf_dir):
    """Changes and sites summed over all pairs, from which the estimates follow."""
    sums = _totals(spark, sf_dir).groupBy("gene").agg(*(F.sum(c).alias(c) for c in selection.SUMS))
    return _rounded(sums, 3, *selection.SUMS)


@query(f"with {SEQS} select gene, species, count(distinct label) as n_strains from seqs group by all having count(distinct label) >= 3")
def species_with_strains(spark, sf_dir):
    n = _seqs(spark, sf_dir).groupBy("gene", "species").agg(F.count_distinct("label").alias("n_strains"))
    return n.filter("n_strains >= 3")


_BY_SPECIES = f"""{CODON_COLS}, counts as (select species, gene, col, codon, count(*) as k from every where codon not in ('TAA', 'TAG', 'TGA') group by all),
met as (select a.species, a.gene, a.col, a.codon as x, b.codon as y, case when a.codon = b.codon then a.k * (a.k - 1) / 2 else a.k * b.k end as pairs
  from counts a join counts b on a.species = b.species and a.gene = b.gene and a.col = b.col and a.codon <= b.codon),
totals as (select species, gene, col, sum(pairs * sd) as sd, sum(pairs * nd) as nd, sum(pairs * s) as s, sum(pairs * n) as n from met join pair_table using (x, y) where pairs > 0 group by all)"""


@query(
    _on_panel(
        f"""with {_BY_SPECIES}, est as (select species, gene, case when ps > 0.6 then null else round(omega, 6) end as omega from (
      select species, gene, ps, case when ds > 0 then dn / ds end as omega from (
        select species, gene, ps, case when ps < 0.749999999 then 0.0::double - 0.75::double * ln(1 - ps * 4 / 3) end as ds,
          case when pn < 0.749999999 then 0.0::double - 0.75::double * ln(1 - pn * 4 / 3) end as dn
        from (select species, gene, sum(sd) / nullif(sum(s), 0) as ps, sum(nd) / nullif(sum(n), 0) as pn from totals group by species, gene)))),
    classes as (select species as metric, gene in ({", ".join(f"'{c}'" for c in CONTROLS)}) as first, omega as value from est where omega is not null
      qualify count(*) filter (gene in ({", ".join(f"'{c}'" for c in CONTROLS)})) over (partition by species) >= 2
        and count(*) filter (gene not in ({", ".join(f"'{c}'" for c in CONTROLS)})) over (partition by species) >= 2),
    {UTEST} select metric as species, n1, n2, round(u, 3) as u, round(2 * u / (n1 * n2) - 1, 6) as delta from tests"""
    )
)
def panel_replication(spark, sf_dir):
    """Within each species: whether control genes differ from the others in omega, where both are two or more."""
    totals = selection.within_columns(_panel(spark, sf_dir), "species", "gene")
    est = _rounded(selection.estimate(totals, ["species", "gene"]), 6, "omega")
    t = statistics.rank_test(selection.replication(est, "species", CONTROLS), ["species"])
    return _rounded(_rounded(t.select("species", "n1", "n2", "u", "delta"), 3, "u"), 6, "delta")


# --- conservation and motifs -------------------------------------------------------------------


def _scores(spark, sf_dir):
    return conservation.conservation(_panel_rows(spark, sf_dir))


_SCORED = f"{CELLS}, {HENIKOFF}, {COLS}"


@query(
    _on_panel(
        f"""with {_SCORED} select gene, count(*) as n_columns, count(entropy) as n_scored, count(*) filter (entropy <= 1e-9) as n_invariant,
    count(*) filter (round(entropy, 6) > 0) as n_variable, round(avg(gap_fraction), 4) as mean_gaps, round(max(gap_fraction), 4) as most_gaps, round(avg(entropy), 4) as mean_entropy,
    round(avg(1 - entropy / 2), 4) as mean_conservation, round(min(1 - entropy / 2), 4) as least_conservation,
    round(avg((entropy <= 1e-9)::int), 4) as invariant_fraction, round(avg((entropy <= 1e-9)::int) ^ 3, 4) as invariant_cubed from scores group by gene"""
    )
)
def gene_conservation_summary(spark, sf_dir):
    e, same = F.col("entropy"), F.when(F.col("entropy").isNotNull(), (F.col("entropy") <= 1e-9).cast("int"))
    out = _scores(spark, sf_dir).groupBy("gene").agg(
        F.count("*").alias("n_columns"), F.count(e).alias("n_scored"), F.count_if(e <= 1e-9).alias("n_invariant"), F.count_if(F.round(e, 6) > 0).alias("n_variable"),
        F.avg("gap_fraction").alias("mean_gaps"), F.max("gap_fraction").alias("most_gaps"), F.avg(e).alias("mean_entropy"), F.avg("conservation").alias("mean_conservation"),
        F.min("conservation").alias("least_conservation"), F.avg(same).alias("invariant_fraction"), F.pow(F.avg(same), F.lit(3)).alias("invariant_cubed"),
    )
    return _rounded(out, 4, *out.columns[5:])


CATALYTIC = (10, 50, 101)


@query(
    _on_panel(
        f"""with {_SCORED}, v as (select gene, col, round(1 - entropy / 2, 6) as c from scores where entropy is not null),
    w as (select gene, c, count(*) as n from v group by all),
    o as (select gene, c, 100.0::double * (sum(n) over (partition by gene order by c desc) - n / 2.0::double) / sum(n) over (partition by gene) as midrank from w),
    firsts as (select gene, arg_min(r, label) as r from rws group by gene),
    numbered as (select gene, col, case when ch <> '-' then sum((ch <> '-')::int) over (partition by gene order by col) end as ref_position
      from (select gene, unnest(range(1, length(r) + 1))::int as col, unnest(string_split(r, '')) as ch from firsts))
    select gene, ref_position::int as ref_position, col, v.c as conservation, round(midrank, 4) as midrank, midrank <= 10 as in_top10
    from numbered join v using (gene, col) join o using (gene, c) where ref_position in {CATALYTIC}"""
    )
)
def catalytic_ranks(spark, sf_dir):
    """Columns of given positions of the reference row, and how many columns are conserved better."""
    wanted = F.broadcast(spark.createDataFrame([(p,) for p in CATALYTIC], "ref_position bigint"))  # three rows
    at = conservation.numbered(_panel_rows(spark, sf_dir)).select("gene", "col", "ref_position").join(wanted, "ref_position")
    c = _scores(spark, sf_dir).filter("conservation is not null").select("gene", "col", F.round("conservation", 6).alias("conservation"))
    found = at.join(c, ["gene", "col"]).join(statistics.midranks(c, "gene", "conservation", 6).drop("n", "strict", "worst"), ["gene", "conservation"])
    out = found.select("gene", F.col("ref_position").cast("int").alias("ref_position"), "col", "conservation", "midrank", (F.col("midrank") <= 10).alias("in_top10"))
    return _rounded(out, 4, "midrank")


#: Positions, the letter expected there, and the motif that each should be in.
SITES = [(12, "L", "turn", "[ILV].[ST]"), (40, "S", "pair", "S[A-Z][A-Z]?G|LS"), (77, "G", "run", "(?:AA|LL|SS)[KRG]?"), (3, "A", "head", "^M..|A[A-Z]A")]


@query(
    f"""with {SEQS}, {PROTEINS}, sites(position, expected, motif, pattern) as (values {", ".join(map(str, SITES))})
    select label, position::int as position, motif, expected, aa[position:position] as observed, aa[position:position] = expected as as_expected,
      len(list_filter(range(greatest(0, position - 32), position), lambda s: length(regexp_extract(substr(aa, (s + 1)::bigint, 32), '^(?:' || pattern || ')')) >= position - s)) > 0 as in_motif,
      aa[greatest(1, position - 5):position + 5] as context
    from proteins, sites where position <= length(aa)"""
)
def motif_sites(spark, sf_dir):
    """Whether letters stand at their positions in every protein, and within a match of their motif."""
    proteins = _proteins(spark, sf_dir).select(F.col("target").alias("label"), "seq")
    sites = spark.createDataFrame(SITES, "position int, expected string, motif string, pattern string")  # four rows
    return conservation.verified_sites(proteins, sites)


def _strains(spark, sf_dir):
    """The panel with genes apart by species, where a species has three sequences or more."""
    seqs = _panel(spark, sf_dir).withColumn("gene", F.concat_ws(":", "gene", "species"))
    enough = seqs.groupBy("gene").agg(F.count("*").alias("n")).filter("n >= 3")
    return seqs.join(enough, "gene", "left_semi")


_STRAINS = PANEL.replace("source as gene, lang as species,", "source || ':' || lang as gene, lang as species,").replace("), seqs as (", "), every_seq as (") + ", seqs as (select * from every_seq qualify count(*) over (partition by gene) >= 3)"


@query(
    f"""{_on_panel(SQL["dnds_within"]).replace(PANEL, _STRAINS).replace("with ", "with e as (with ", 1)}), sized as (with {_STRAINS} select gene, count(*) as n_sequences from seqs group by gene)
    select string_split(gene, ':')[1] as gene, string_split(gene, ':')[2] as species, n_sequences, string_split(gene, ':')[1] in ({", ".join(f"'{c}'" for c in CONTROLS)}) as control,
      ps, pn, ds, dn, omega, saturated from e join sized using (gene)"""
)
def selection_within_species(spark, sf_dir):
    """Pooled omega of each gene within each species of three strains or more."""
    sizes = _strains(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n_sequences"))
    found = dnds_within(spark, sf_dir, seqs=_strains).join(sizes, "gene")
    name = F.split("gene", ":")
    return found.withColumns({"species": name[1], "gene": name[0]}).withColumn("control", F.col("gene").isin(CONTROLS))


@query()
def motif_windows(spark, sf_dir):
    """The six best conserved stretches of seven columns of each gene that don't overlap, the best first."""
    return _rounded(conservation.motifs(_scores(spark, sf_dir)), 6, "mean_conservation")


@query(
    """select event_id, user_id, round(case when count(value) over w >= 7 then avg(value) over w end, 6) as rolling from events
    window w as (partition by user_id order by ts, event_id rows between 6 preceding and current row)"""
)
def rolling_full_window(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return _rounded(conservation.rolling(e, ["user_id"], ["ts", "event_id"], "value", 7, 7).select("event_id", "user_id", "rolling"), 6, "rolling")


@query(
    _on_panel(
        f"""with {CELLS}, firsts as (select gene, arg_min(r, label) as r from rws group by gene)
    select c.gene, c.label, count(*) filter (ch = r[col]) as n_same, count(*) filter (ch <> r[col] and ch <> '-' and r[col] not in ('', '-')) as n_different,
      count(*) filter (ch = '-' or r[col] in ('', '-')) as n_gap from cells c join firsts using (gene) group by all"""
    ).replace("(ch = r[col])", "(ch = r[col] and ch <> '-')")
)
def match_matrix(spark, sf_dir):
    """Each row beside its gene's reference row: places that are the same, differ, or have a gap in either."""
    rows = _panel_rows(spark, sf_dir)
    first = rows.groupBy("gene").agg(F.min_by("row", "label").alias("ref"))
    state = conservation.match_states(F.col("row"), F.col("ref"))
    each = rows.filter("length(row) > 0").join(first, "gene").select("gene", "label", state.alias("s"))
    count = lambda k, name: F.size(F.filter("s", lambda x: x == k)).cast("bigint").alias(name)
    return each.select("gene", "label", count(2, "n_same"), count(1, "n_different"), count(0, "n_gap"))


@query(
    _on_panel(f"""with {SEQS}, threaded as (select label, regexp_replace(nt[1:length(nt) - length(nt) % 3], '(.{{21}})', '\\1---', 'g') as row from seqs)
    select label, length(row)::int as length, md5(row) as digest from threaded""")
)
def codon_threading(spark, sf_dir):
    """Codons put under a protein row that has a gap behind every seventh residue."""
    p = _panel(spark, sf_dir).select("label", "nt", F.regexp_replace(sequence.translated(F.col("nt")), "(.{7})", "$1-").alias("protein"))
    row = homology.threaded_column(F.col("protein"), F.col("nt"))
    return p.select("label", row.alias("row")).select("label", F.length("row").alias("length"), F.md5("row").alias("digest"))


@query(
    _on_panel(
        f"""with {CELLS}, {CONSENSUS}, parts as (select taxon as gene, grp as taxon, string_agg(coalesce(ch, '-'), '' order by col) as row
      from (select t.taxon, t.grp, unnest(range(1, n + 1)) as col from (select taxon, grp, max(col) as n from taxa group by all) t) left join taxa using (taxon, grp, col) group by all),
    lengths as (select gene, max(length(row)) as n from parts group by gene),
    every as (select taxon, gene, rpad(coalesce(row, ''), n::int, '-') as row, row is not null as own from (select distinct taxon from parts) cross join lengths left join parts using (taxon, gene))
    select taxon, length(string_agg(row, '' order by gene))::int as length, md5(string_agg(row, '' order by gene)) as digest, count(*) filter (own) as n_genes from every group by taxon"""
    )
)
def concatenated_alignment(spark, sf_dir):
    """The species' consensus rows of all genes one behind the other."""
    cons = distances.consensus(_panel_rows(spark, sf_dir), "gene", "species")
    parts = distances.consensus_rows(cons)
    out = tables.concatenated(parts.select(F.col("grp").alias("gene"), "taxon", "row"), "taxon", "gene", "row")
    return out.select("taxon", F.length("row").alias("length"), F.md5("row").alias("digest"), "n_genes")


# --- trees -------------------------------------------------------------------------------------


@query(
    f"""with {CELLS}, {CONSENSUS}, pairs as (select x.grp, x.taxon as a, y.taxon as b, 100.0::double * count(*) filter (x.ch = y.ch) / count(*) as identity
      from taxa x join taxa y on x.grp = y.grp and x.col = y.col and x.taxon < y.taxon group by all)
    select grp, count(*) as n_pairs, round(min(identity), 4) as least, round(avg(identity), 4) as mean from pairs group by grp"""
)
def pair_matrix_summary(spark, sf_dir):
    """Least and mean identity over the pairs of each group's taxa."""
    counts = distances.pair_counts(distances.consensus(_rows(spark, sf_dir), "species", "gene"))
    identity = 100 * (F.col("valid") - F.col("ts") - F.col("tv")) / F.col("valid")
    out = counts.groupBy("grp").agg(F.count("*").alias("n_pairs"), F.min(identity).alias("least"), F.avg(identity).alias("mean"))
    return _rounded(out, 4, "least", "mean")


def _supported(spark, sf_dir):
    cons = distances.consensus(_panel_rows(spark, sf_dir), "species", "gene")
    splits = distances.tree_splits(distances.replicate_distances(cons, 100), ("nj",))
    return distances.support(splits, 100).select("grp", "split", "support").persist(), cons.select("taxon").distinct().count()


@query()
def discordance(spark, sf_dir):
    """Each language's tree of the sources beside that of English: shared splits, distance, conflicts, and a clade."""
    s, taxa = _supported(spark, sf_dir)
    rows, _ = distances.discordance(s.filter("grp != 'en'"), s.filter("grp = 'en'"), taxa)
    clade = distances.monophyletic(s.filter("grp != 'en'"), 0b110, taxa, ["grp"])
    return _rounded(rows.join(clade, "grp"), 6, "nrf", "mean_support")


@query()
def conflicts(spark, sf_dir):
    s, taxa = _supported(spark, sf_dir)
    return distances.discordance(s.filter("grp != 'en'"), s.filter("grp = 'en'"), taxa)[1]


@query()
def rooted_trees(spark, sf_dir):
    """The tree of each language's sources as text, rooted halfway between its farthest tips, with the support of its splits."""
    matrices = written(distances.replicate_distances(distances.consensus(_panel_rows(spark, sf_dir), "species", "gene"), 100))
    supports = distances.support(distances.tree_splits(matrices, ("nj",)), 100)
    nodes = newick.read(distances.tree_texts(matrices, supports).withColumnRenamed("grp", "tree"))
    return trees.texts(trees.midpoint_rooted(nodes))


SPECIES = {s: [f"{s}{i}" for i in range(4)] for s in ("a", "b", "c", "d")}


@query()
def topology_recovery(spark, sf_dir):
    """Splits of a simulated tree that neighbour joining finds again, from codons and from bases; takes no table."""
    tree = synthetic.species_tree(SPECIES)
    truth = distances.splits_of_newick(tree)
    kinds = {"codons": synthetic.codon_panel(spark, tree, 12, 400, [0.2], scale=0.5, seed=3), "bases": synthetic.nucleotide_panel(spark, tree, 6, 4000, scale=0.5, seed=5)}
    out = None
    for kind, panel in kinds.items():
        rows = panel.select(F.lit(kind).alias("grp"), "species", "gene", "nt")
        whole = tables.concatenated(rows.withColumnRenamed("nt", "row"), "species", "gene", "row").select(F.lit(kind).alias("gene"), F.lit(0).alias("label"), "species", "row")
        cons = distances.consensus(whole, "gene", "species")
        found = distances.tree_splits(distances.replicate_distances(cons, 0), ("nj",)).select("grp", "split")
        out = found if out is None else out.union(found)
    true = spark.createDataFrame([(k, s) for k in kinds for s in sorted(truth)], "grp string, split bigint")
    return distances.robinson_foulds(out, true, ["grp"])


# --- homology ----------------------------------------------------------------------------------


#: The genome whose records are the queries: the first of each gene in English.
REFERENCE = "en-1"


def _genomes(spark, sf_dir):
    """(genome, gene, target, seq): the panel's proteins; the n-th record of each gene in a language is of that language's n-th genome."""
    number = F.row_number().over(Window.partitionBy("species", "gene").orderBy("label"))
    return _panel(spark, sf_dir).select(F.concat_ws("-", "species", number).alias("genome"), "gene", F.col("label").alias("target"), sequence.translated(F.col("nt")).alias("seq"))


def _extracted(spark, sf_dir):
    """The reference's genes in every other genome."""
    every = written(_genomes(spark, sf_dir))
    own = every.filter(F.col("genome") == REFERENCE).select("target", "seq")
    others = every.filter(F.col("genome") != REFERENCE).select("genome", "target", "seq")
    return homology.reasons(homology.extraction(own.withColumnRenamed("target", "query"), others, own))


@query()
def rejected_hits(spark, sf_dir):
    """Best hits that aren't called orthologs, and everything that speaks against them."""
    calls = _extracted(spark, sf_dir).filter(~F.col("ortholog_call"))
    return _rounded(calls.select("genome", "query", "target", "score", "identity", "reasons"), 6, "score", "identity")


@query()
def extract_panel(spark, sf_dir):
    """One row for each gene and genome with any hit: the best aligned target, and whether it is called an ortholog."""
    names = ("score", "identity", "query_coverage", "target_coverage")
    return _rounded(_extracted(spark, sf_dir).select("genome", "query", "target", *names, "reciprocal_best_hit", "ortholog_call"), 4, *names)


@query()
def extract_family(spark, sf_dir):
    """Different sequences of all genomes like any of three queries, each under the query of greatest score."""
    every = written(_genomes(spark, sf_dir))
    three = every.filter((F.col("genome") == REFERENCE) & F.col("gene").isin(CONTROLS[:3])).select(F.col("target").alias("query"), "seq")
    return _rounded(homology.family(three, every.select("genome", "target", "seq")), 4, "score", "identity")


# --- families ----------------------------------------------------------------------------------

#: A longer gap costs as much as mismatches, so that substitutions alone never make one: the SQL then knows the rows.
SUBSTITUTIONS = alignment.Scoring(extend=3.0)


def _families(spark, sf_dir):
    proteins = _panel(spark, sf_dir).select("label", sequence.translated(F.col("nt")).alias("seq"))
    return families.families(proteins, SUBSTITUTIONS, least_coverage=0.4)


@query(_on_panel(f"with {SEQS} select label, min(label) over (partition by gene) as family from seqs"))
def family_members(spark, sf_dir):
    """Families of the panel's proteins by their alignments alone; the SQL knows them from the genes."""
    return _families(spark, sf_dir).select("label", "family")


@query()
def pairwise_identity_global(spark, sf_dir):
    """Score and identity of all pairs of different sequences of each family, aligned globally."""
    found = families.pair_figures(written(_families(spark, sf_dir)), SUBSTITUTIONS)
    return _rounded(found.select("family", "a", "b", "score", (100 * F.col("identity")).alias("identity")), 6, "score", "identity")


def _family_rows(spark, sf_dir):
    return families.star_alignment(written(_families(spark, sf_dir)), SUBSTITUTIONS)


@query()
def center_star_msa(spark, sf_dir):
    """A multiple alignment of each family."""
    return _family_rows(spark, sf_dir)


_PROTEIN_ROWS = f"""{PANEL}, {PROTEINS}, rws as (
  select min(label) over (partition by s.gene) as gene, label, s.species as species, aa as r from seqs s join proteins using (label)
)"""


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS} select gene as family, col, round(gap_fraction, 4) as gap_fraction, consensus,
    round(entropy, 4) + 0.0::double as entropy, round(1 - entropy / log2(20), 4) + 0.0::double as conservation from scores""".replace(ROWS, _PROTEIN_ROWS)
)
def family_conservation(spark, sf_dir):
    """Conservation of the columns of each family's multiple alignment."""
    rows = _family_rows(spark, sf_dir).select(F.col("family").alias("gene"), "label", F.lit("").alias("species"), "row")
    found = conservation.conservation(rows, letters=20).withColumnRenamed("gene", "family")
    return _rounded(found, 4, "gap_fraction", "entropy", "conservation")


@query()
def aligned_segments(spark, sf_dir):
    """The ungapped stretches of the local alignments of items with their candidates, and the gaps between them."""
    items, proteins = _items(spark, sf_dir), _proteins(spark, sf_dir)
    pairs = homology.candidates(items, proteins).select("query", "target")
    whole = pairs.join(items.withColumnRenamed("seq", "q"), "query").join(proteins.withColumnRenamed("seq", "t"), "target")
    return alignment.gaps(alignment.aligned_segments(whole.repartition("query", "target")), "query", "target")


# --- records and plain tables ------------------------------------------------------------------


@query(
    f"""with {SEQS}, n as (select label, species, length(nt)::bigint as n, length(nt) - length(translate(nt, 'GC', '')) as gc from seqs)
    select label, species as title, n::int as length, ((20000 * gc + n) // (2 * nullif(n, 0)))::double / 10000 as gc from n"""
)
def record_metadata(spark, sf_dir):
    """Names and contents of records; the share of G and C comes from the counts, so that it is rounded once, in whole numbers."""
    n, gc = F.length("nt").cast("bigint"), (F.length("nt") - F.length(F.translate("nt", "GC", ""))).cast("bigint")
    counts = _seqs(spark, sf_dir).select("label", F.col("species").alias("title"), n.cast("int").alias("length"), n.alias("n"), gc.alias("g"))
    return counts.select("label", "title", "length", F.expr("cast((20000 * g + n) div (2 * nullif(n, 0)) as double) / 10000").alias("gc"))


@query("select item_id, length(text) as length from benchmark where item_id <= 20")
def exactly_one_lookup(spark, sf_dir):
    """Items looked up by number; a number that is absent or repeated fails the job."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    keys = items.filter("item_id <= 20").select("item_id")
    return tables.exactly_one(keys, items, "item_id").select("item_id", F.length("text").cast("bigint").alias("length"))


@query(
    f"""with {SEQS}, m as ({_METRICS}), long as (select * from m where length >= 300 and length % 3 = 0 and gc3 is not null) select label, species, gc3,
    round(100.0::double * (rank() over (partition by species order by gc3) - 1) / count(*) over (partition by species), 6) as percentile from long"""
)
def coding_background(spark, sf_dir):
    """``background_percentile`` among whole coding sequences of 300 bases or more."""
    m = sequence_metrics(spark, sf_dir).filter("length >= 300 and length % 3 = 0 and gc3 is not null").select("label", "species", "gc3").persist()
    return _rounded(composition.percentiles(m, "species", "gc3"), 6, "percentile")


@query(
    f"""with {SEQS}, {CODONS}, {RSCU.format('0.0::double', '')} select codon, aa, round(log2(rscu + 0.05), 6) as heat from rscu where n_synonyms > 1"""
)
def log2_rscu(spark, sf_dir):
    r = composition.rscu(composition.codon_counts(_seqs(spark, sf_dir))).filter("n_synonyms > 1")
    return _rounded(r.select("codon", "aa", F.log2(F.col("rscu") + 0.05).alias("heat")), 6, "heat")


@query(
    _on_panel(f"""with {SEQS}, {FLAGGED} select gene, bool_and(included) as all_included, bool_or(included) as any_included, count(*) filter (not included) as n_excluded,
    count(*) filter (list_contains(flags, 'internal_stop')) as n_stopped from kept group by gene""")
)
def all_any_flags(spark, sf_dir):
    f = quality.flags(_panel(spark, sf_dir))
    return f.groupBy("gene").agg(
        F.every("included").alias("all_included"), F.some("included").alias("any_included"), F.count_if(~F.col("included")).alias("n_excluded"),
        F.count_if(F.array_contains("flags", "internal_stop")).alias("n_stopped"),
    )


@query(
    _on_panel(f"""with {SEQS}, {FLAGGED} select label, gene, length(nt)::int as length from kept where included and gene = 'src1'""")
)
def load_gene(spark, sf_dir):
    """The sequences of one gene that pass their checks, by a semi-join with the checked records."""
    s = _panel(spark, sf_dir)
    good = quality.flags(s).filter("included").select("label")
    return s.filter("gene = 'src1'").join(good, "label", "left_semi").select("label", "gene", F.length("nt").alias("length"))


@query(
    f"""with {SEQS}, sizes as (select species, gene, count(*) as n from seqs group by all)
    select species, count(*) as n_genes, sum(n)::bigint as n_sequences, min(n) as least, max(n) as most from sizes group by species"""
)
def class_sizes(spark, sf_dir):
    n = _seqs(spark, sf_dir).groupBy("species", "gene").agg(F.count("*").alias("n"))
    return n.groupBy("species").agg(F.count("*").alias("n_genes"), F.sum("n").alias("n_sequences"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(
    _on_panel(f"""with {WITHIN}, {FLAGGED}, est as ({ESTIMATE.format('gene', 'totals')})
    select (select count(*) from kept) as n_found, (select count(*) from kept where included) as n_included, (select median(length(nt)) from kept where included)::double as median_length,
      (select max(omega) from est) as greatest_omega, (select count(*) from est where saturated) as n_saturated""")
)
def headline_metrics(spark, sf_dir):
    f = quality.flags(_panel(spark, sf_dir))
    one = f.agg(F.count("*").alias("n_found"), F.count_if("included").alias("n_included"), F.median(F.when(F.col("included"), F.length("nt"))).alias("median_length"))
    est = dnds_within(spark, sf_dir, _panel).agg(F.max("omega").alias("greatest_omega"), F.count_if("saturated").alias("n_saturated"))
    return one.join(F.broadcast(est))  # one row each


def _firsts(rows):
    """(gene, ref): each gene's first row, written, so that Spark knows from its size that rows needn't be shuffled to meet it."""
    return written(rows.groupBy("gene").agg(F.min_by("row", "label").alias("ref")))


@query(
    f"""with {CELLS}, firsts as (select gene, arg_min(r, label) as r from rws group by gene),
    sides as (select c.gene, label, col, ch as x, r[col] as y, sum((ch <> '-')::int) over w as p, sum((r[col] <> '-')::int) over w as q
      from cells c join firsts using (gene) where r[col] <> '' window w as (partition by c.gene, label order by col)),
    runs as (select *, col - row_number() over (partition by gene, label order by col) as island from sides where x <> '-' and y <> '-'),
    segs as (select gene, label, island, min(p) - 1 as q_start, max(p) as q_end, min(q) - 1 as t_start, max(q) as t_end from runs group by all)
    select gene, label, (row_number() over w - 1)::int as segment, q_start::int as q_start, q_end::int as q_end, t_start::int as t_start, t_end::int as t_end,
      (q_start - lag(q_end) over w + t_start - lag(t_end) over w)::double as gap from segs window w as (partition by gene, label order by island)"""
)
def segment_gaps(spark, sf_dir):
    """Each row of a gene beside its first: aligned segments, and the letters of both that lie between two of them."""
    rows = _rows(spark, sf_dir)
    both = rows.join(_firsts(rows), "gene").select("gene", "label", F.col("row").alias("q"), F.substring("ref", F.lit(1), F.length("row")).alias("t"))
    out = alignment.segments_of_pairs(both)
    return out.withColumn("gap", F.col("gap").cast("double"))


@query(
    _on_panel(f"""with {CELLS}, firsts as (select gene, arg_min(r, label) as r from rws group by gene), marked as (
      select c.gene, c.label, c.col, case when (c.col + c.label) % 11 = 0 then '-' else ch end as x, case when c.col % 7 = 0 then '-' else r[c.col] end as y
      from cells c join firsts using (gene) where c.label % 10 = 0 and r[c.col] <> '')
    select gene, label, col, case when x <> '-' then sum((x <> '-')::int) over w end::double as i, case when y <> '-' then sum((y <> '-')::int) over w end::double as j
    from marked window w as (partition by gene, label order by col)""")
)
def running_places(spark, sf_dir):
    """Positions of two aligned rows at each column, gaps put in by rule; rows numbered by tens are the queries."""
    rows = _panel_rows(spark, sf_dir)
    # A row meets its gene's first before it becomes columns; all columns of a gene never meet in one task.
    met = rows.filter("label % 10 = 0 and length(row) > 0").join(_firsts(rows), "gene").select("gene", "label", "ref", F.posexplode(F.split("row", "")).alias("at", "ch"))
    each = met.withColumn("col", F.col("at") + 1).filter(F.col("col") <= F.length("ref"))
    x = F.when((F.col("col") + F.col("label")) % 11 == 0, "-").otherwise(F.col("ch"))
    y = F.when(F.col("col") % 7 == 0, "-").otherwise(F.substring("ref", F.col("col"), F.lit(1)))
    both = each.select("gene", "label", "col", x.alias("x"), y.alias("y"))
    out = tables.running_places(both, ["gene", "label"], "col", "x", "y")
    return out.select("gene", "label", "col", F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"))


# --- structure and statistics ------------------------------------------------------------------


@query(
    f"""with {DISTANT}, p as (select *, lag(vec_id) over w as last_id, lag(x) over w as lx, lag(y) over w as ly, lag(z) over w as lz, lag(distance) over w as last from d
      window w as (partition by label order by vec_id))
    select label, vec_id, round(sqrt((x - lx) ** 2 + (y - ly) ** 2 + (z - lz) ** 2), 6) as distance,
      vec_id - last_id = 1 and sqrt((x - lx) ** 2 + (y - ly) ** 2 + (z - lz) ** 2) < 4.3 as bonded, round(coalesce((distance + last) / 2, distance, last), 6) as value from p where last_id is not null"""
)
def linked_segments(spark, sf_dir):
    p = _distant(spark, sf_dir).select("label", "vec_id", "x", "y", "z", F.col("distance").alias("own_value"))
    return _rounded(structure.linked_segments(p, "label", "vec_id", "own_value"), 6, "distance", "value")


@query(
    f"""with {DISTANT} select count(*) as n, count(z) as n_scored, round(avg(z), 5) as mean_value, round(min(distance), 5) as least_distance, round(max(distance), 5) as greatest_distance,
    round(avg(distance), 5) as mean_distance, count(*) filter (distance <= 1) as n_near, round(avg(z) filter (distance <= 1), 5) as mean_near,
    round(avg(z) filter (distance > 1), 5) as mean_far, round(corr(distance, z), 5) as correlation from d"""
)
def structure_summary(spark, sf_dir):
    out = structure.summary(_distant(spark, sf_dir), "z", 1.0)
    return _rounded(out, 5, *(c for c in out.columns if not c.startswith("n")))


@query()
def backbone_angles(spark, sf_dir):
    """Both torsion angles of each residue of a chain of four points a residue; a chain's ends lack one."""
    return _rounded(structure.backbone(_points(spark, sf_dir), "label", "vec_id"), 4, "phi", "psi")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS}, firsts as (select gene, arg_min(r, label) as r from rws group by gene),
    residues as (select gene as chain, pos, r[pos] as aa from firsts, (select unnest(range(7, 81))::int as pos) where r[pos] not in ('', '*', 'X'))
    select chain, pos + 100 as number, aa, pos::double as ref_position, aa as ref_aa, pos::double as col, round(1 - entropy / log2(20), 4) + 0.0::double as conservation
    from residues left join scores on gene = chain and scores.col = pos""".replace(ROWS, _PROTEIN_ROWS.replace("min(label) over (partition by s.gene)", "s.gene"))
)
def residue_conservation(spark, sf_dir):
    """Residues of a chain, the middle of each gene's first protein, with the conservation of the columns where they stand.

    The chain's atoms have alternates, and numbers of their own; its ends are missing.
    """
    proteins = composition.proteins(_panel(spark, sf_dir), "gene", "label", "species", aa="row")
    first = proteins.groupBy("gene").agg(F.min_by("row", "label").alias("seq")).select(F.col("gene").alias("chain"), "seq")
    name = F.create_map(*(F.lit(x) for k, v in pdb.LETTERS.items() for x in (v, k)))
    each = first.select("chain", F.explode(F.sequence(F.lit(7), F.least(F.lit(80), F.length("seq")))).alias("at"), "seq").filter(F.length("seq") >= 7)
    residue = F.coalesce(F.try_element_at(name, F.substring("seq", F.col("at"), F.lit(1))), F.lit("UNK"))
    made = each.select("chain", (F.col("at") + 100).alias("number"), residue.alias("residue"), F.explode(F.array(F.lit(0), F.lit(1))).alias("alternate"), "at")
    atoms = made.select(
        "chain", "number", "residue", (2 * F.col("at") + F.col("alternate")).alias("serial"), F.lit("CA").alias("atom"), F.lit("ATOM").alias("record"),
        *((F.col("at") * k + F.col("alternate")).cast("double").alias(c) for k, c in enumerate("xyz", 1)), F.lit(0.0).alias("b"),
    )
    placed = structure.reference_positions(structure.residue_table(atoms, pdb.STANDARD), first, pdb.LETTERS)
    found = structure.with_column_scores(placed, conservation.numbered(proteins), conservation.conservation(proteins, letters=20))
    out = found.select("chain", "number", "aa", F.col("ref_position").cast("double").alias("ref_position"), "ref_aa", F.col("col").cast("double").alias("col"), "conservation")
    return _rounded(out, 4, "conservation")


@query()
def spearman_test(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir).select("label", "gc", "gc3")
    return _rounded(statistics.spearman_test(m, "gc", "gc3", "label"), 6, "rho", "lo", "hi", "p")


@query()
def resampled_statistics(spark, sf_dir):
    out = statistics.resampled_statistics(_two_classes(spark, sf_dir), ["metric"])
    return _rounded(out, 6, *out.columns[1:])

