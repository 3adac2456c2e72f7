"""The queries on the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genetic_code, sequence
from ..operators import composition, conservation, distances, homology, quality, selection, statistics, structure, tables
from ..operators.composition import AS_ALIGNED, AS_BASES, LETTERS
from ..operators.lineage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LETTERS_ONLY = "regexp_replace(lower(text), '[^a-z]', '', 'g')"
SEQS = f"seqs as (select doc_id as label, source as gene, lang as species, translate({LETTERS_ONLY}, '{LETTERS}', '{AS_BASES}') as nt from documents)"
ROWS = f"rws as (select source as gene, doc_id as label, lang as species, translate({LETTERS_ONLY}, '{LETTERS}', '{AS_ALIGNED}') as r from documents)"
CODE = "code(codon, aa, n_synonyms) as (values " + ", ".join(
    f"('{c}', '{a}', {genetic_code.AMINO_ACIDS.count(a)})" for c, a in genetic_code.CODE.items()
) + ")"
CODONS = f"""{CODE}, raw as (
  select label, gene, species, regexp_extract_all(nt, '...') as cs from seqs
), trimmed as (
  select label, gene, species, case when cs[-1] in ('TAA', 'TAG', 'TGA') then cs[1:len(cs) - 1] else cs end as cs from raw
), codons as (
  select label, gene, species, codon, row_number() over (partition by label order by i) - 1 as pos
  from (select label, gene, species, unnest(cs) as codon, unnest(range(len(cs))) as i from trimmed)
  where length(codon) = 3
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.sequences(_table(spark, sf_dir, "documents"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conservation.aligned(_table(spark, sf_dir, "documents"))


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# --- composition -------------------------------------------------------------------------------

GC = "(length({0}) - length(translate({0}, 'GC', '')))::double / nullif(length({0}), 0)"
THIRD = "regexp_replace(nt[1:length(nt) - length(nt) % 3], '(.)(.)(.)', '\\{0}', 'g')"
_METRICS = f"""select label, gene, species, length(nt)::int as length, round({GC.format("nt")}, 6) as gc,
  round((length(translate(nt, 'C', '')) - length(translate(nt, 'G', '')))::double
    / nullif(2 * length(nt) - length(translate(nt, 'G', '')) - length(translate(nt, 'C', '')), 0), 6) as gc_skew,
  {", ".join(f"round({GC.format(THIRD.format(i))}, 6) as gc{i}" for i in (1, 2, 3))} from seqs"""


@query(f"with {SEQS} {_METRICS}")
def sequence_metrics(spark, sf_dir):
    return _rounded(composition.metrics(_seqs(spark, sf_dir)), 6, "gc", "gc_skew", "gc1", "gc2", "gc3")


@query(f"with {SEQS}, {CODONS} select codon, count(*) as n from codons join code using (codon) group by codon")
def codon_counts(spark, sf_dir):
    return composition.codon_counts(_seqs(spark, sf_dir))


RSCU = """rscu as (
  select codon, aa, n_synonyms, (coalesce(n, 0) + {0}) * n_synonyms::double
    / nullif(sum(coalesce(n, 0) + {0}) over (partition by aa), 0) as rscu
  from code left join (select codon, count(*) as n from codons {1} group by codon) using (codon) where aa <> '*'
)"""


@query(f"with {SEQS}, {CODONS}, {RSCU.format('0.0::double', '')} select codon, aa, n_synonyms, round(rscu, 6) as rscu from rscu")
def rscu(spark, sf_dir):
    return _rounded(composition.rscu(composition.codon_counts(_seqs(spark, sf_dir))), 6, "rscu")


TRUSTED = "where label in (select doc_id from labels where quality = 1)"
WEIGHTS = f"""{RSCU.format('0.5::double', TRUSTED)}, weights as (
  select codon, aa, rscu / max(rscu) over (partition by aa) as weight from rscu where n_synonyms > 1
)"""


def _reference(spark, sf_dir) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("label"))
    return _seqs(spark, sf_dir).join(good, "label", "left_semi")


@query(f"with {SEQS}, {CODONS}, {WEIGHTS} select codon, aa, round(weight, 6) as weight from weights")
def cai_weights(spark, sf_dir):
    return _rounded(composition.cai_weights(_reference(spark, sf_dir)), 6, "weight")


CAI = """cai as (
  select label, exp(avg(ln(weight))) as cai from codons join weights using (codon) where pos > 0 group by label
)"""


@query(f"with {SEQS}, {CODONS}, {WEIGHTS}, {CAI} select label, round(cai, 6) as cai from seqs left join cai using (label)")
def cai_per_sequence(spark, sf_dir):
    return _rounded(composition.cai(_seqs(spark, sf_dir), composition.cai_weights(_reference(spark, sf_dir))), 6, "cai")


def _sql_mean(name: str) -> str:
    """A mean to four decimals of values with six, in whole numbers: no rounding of a binary sum decides a tie."""
    n, x = f"count({name})", f"sum(round(({name}::double + 1) * 1000000)::bigint)"
    return f"(((2 * {x} + 100 * {n}) // (200 * nullif({n}, 0)))::bigint - 10000)::double / 10000"


def _mean(name: str):
    n, x = f"count({name})", f"sum(cast(round((cast({name} as double) + 1) * 1000000) as bigint))"
    return F.expr(f"cast((2 * {x} + 100 * {n}) div (200 * nullif({n}, 0)) - 10000 as double) / 10000")


@query(
    f"""with {SEQS}, m as ({_METRICS}) select gene, species, count(*) as n_sequences, {_sql_mean("gc")} as gc,
    {_sql_mean("gc3")} as gc3, {_sql_mean("gc_skew")} as gc_skew, {_sql_mean("length")} as length from m group by gene, species"""
)
def gene_level_means(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir)
    names = ("gc", "gc3", "gc_skew", "length")
    return m.groupBy("gene", "species").agg(F.count("*").alias("n_sequences"), *(_mean(c).alias(c) for c in names))


@query(
    f"""with {SEQS}, m as ({_METRICS}) select gene, {", ".join(f"round(avg(gc3) filter (species = '{s}'), 4) as {s}" for s in ("de", "en", "es", "fr"))}
    from m group by gene"""
)
def gene_species_pivot(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir)
    return _rounded(m.groupBy("gene").pivot("species", ["de", "en", "es", "fr"]).agg(F.avg("gc3")), 4, "de", "en", "es", "fr")


@query(
    f"""with {SEQS}, {CODONS}, n as (select species, codon, count(*) as n from codons group by all),
    sp as (select distinct species from n), r as (
      select sp.species, codon, aa, coalesce(n, 0) * n_synonyms::double / nullif(sum(coalesce(n, 0)) over (partition by sp.species, aa), 0) as rscu
      from sp cross join code left join n using (species, codon) where aa <> '*' and n_synonyms > 1)
    select aa || '-' || codon as codon, {", ".join(f"round(max(rscu) filter (species = '{s}'), 6) as {s}" for s in ("de", "en", "es", "fr"))} from r group by all"""
)
def rscu_pivot(spark, sf_dir):
    r = composition.rscu(composition.codon_counts(_seqs(spark, sf_dir), "species"), "species").filter("n_synonyms > 1")
    wide = r.groupBy(F.concat_ws("-", "aa", "codon").alias("codon")).pivot("species", ["de", "en", "es", "fr"]).agg(F.max("rscu"))
    return _rounded(wide, 6, "de", "en", "es", "fr")


PROTEINS = f"""{CODE}, proteins as (
  select label, gene, species, coalesce(string_agg(aa, '' order by i), '') as aa
  from (select label, gene, species, nt, unnest(regexp_extract_all(nt || '...', '...')) as codon,
    unnest(range(len(regexp_extract_all(nt || '...', '...')))) as i from seqs)
  left join code using (codon) group by label, gene, species
)"""


@query(f"with {SEQS}, {PROTEINS} select label, aa from proteins")
def translate_sequences(spark, sf_dir):
    return _seqs(spark, sf_dir).select("label", sequence.translated(F.col("nt")).alias("aa"))


@query(
    f"""with {SEQS}, {CODONS}, sense as (select species, label, aa from codons join code using (codon) where aa <> '*'),
    per as (select species, label, aa, count(*) as n from sense group by all),
    whole as (select label, sum(n) as total from per group by label), sizes as (select species, count(distinct label) as k from per group by species)
    select species, aa, round(sum(n::double / total) / any_value(k), 6) as fraction
    from per join whole using (label) join sizes using (species) group by species, aa"""
)
def amino_acid_composition(spark, sf_dir):
    return _rounded(composition.amino_acid_composition(_seqs(spark, sf_dir)), 6, "fraction")


@query(
    f"""with {SEQS}, m as ({_METRICS}) select label, species, gc3,
    round(100.0::double * (rank() over (partition by species order by gc3) - 1) / count(*) over (partition by species), 6) as percentile from m where gc3 is not null"""
)
def background_percentile(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir).select("label", "species", "gc3").filter("gc3 is not null").persist()  # short rows, read twice
    return _rounded(composition.percentiles(m, "species", "gc3"), 6, "percentile")


# --- record checks -----------------------------------------------------------------------------

FLAGGED = """flagged as (
  select label, gene, species, nt, list_filter([
    case when length(translate(nt, 'ACGT', '')) > 0 then 'ambiguous_bases' end,
    case when length(nt) % 3 <> 0 then 'length_not_multiple_of_3' end,
    case when nt[1:3] not in ('ATG', 'GTG', 'TTG') then 'no_start_codon' end,
    case when right(nt, 3) not in ('TAA', 'TAG', 'TGA') then 'no_stop_codon' end,
    case when list_has_any(regexp_extract_all(left(nt, greatest(0, length(nt) - length(nt) % 3 - 3)), '...'), ['TAA', 'TAG', 'TGA']) then 'internal_stop' end,
    case when length(nt)::double / nullif(ref, 0) < 0.8 then 'truncated' when length(nt)::double / nullif(ref, 0) > 1.2 then 'extended' end
  ], lambda x: x is not null) as flags
  from seqs join (select gene, arg_min(length(nt), label) as ref from seqs group by gene) using (gene)
), kept as (select *, len(list_filter(flags, lambda x: x <> 'extended')) = 0 as included from flagged)"""


@query(f"with {SEQS}, {FLAGGED} select label, gene, array_to_string(flags, ';') as flags, included from kept")
def qc_flags(spark, sf_dir, seqs=_seqs):
    return quality.flags(seqs(spark, sf_dir)).select("label", "gene", F.array_join("flags", ";").alias("flags"), "included")


@query(
    f"""with {SEQS}, {FLAGGED} select gene, count(*) as n_found, count(*) filter (included) as n_included,
    count(distinct species) filter (included) as n_species, median(length(nt))::double as median_length,
    min(length(nt))::int as min_length, max(length(nt))::int as max_length from kept group by gene"""
)
def qc_summary(spark, sf_dir, seqs=_seqs):
    return quality.summary(quality.flags(seqs(spark, sf_dir)))


@query(
    f"""with {SEQS}, {FLAGGED}, dims as (select * from (select distinct gene from seqs), (select distinct species from seqs))
    select gene, species, coalesce(state, 0)::int as state from dims
    left join (select gene, species, max(case when included then 2 else 1 end) as state from kept group by all) using (gene, species)"""
)
def presence_matrix(spark, sf_dir, seqs=_seqs):
    s = seqs(spark, sf_dir)
    return quality.presence(quality.flags(s), s.select("gene").distinct(), s.select("species").distinct())


# --- homology ----------------------------------------------------------------------------------

ITEMS = f"items as (select item_id as label, '' as gene, '' as species, translate({LETTERS_ONLY}, '{LETTERS}', '{AS_BASES}') as nt from benchmark)"
ITEM_PROTEINS = PROTEINS.replace(f"{CODE}, ", "").replace("proteins", "item_proteins").replace("from seqs", "from items")
KMERS = """select distinct label, aa[i:i + 2] as kmer from (select label, aa, unnest(range(1, length(aa) - 1)) as i from {0} where length(aa) >= 3)"""
SHARED = f"""{SEQS}, {PROTEINS}, {ITEMS}, {ITEM_PROTEINS}, tk as ({KMERS.format("proteins")}), qk as ({KMERS.format("item_proteins")}),
shared as (select qk.label as query, tk.label as target, count(*) as shared from qk join tk using (kmer) group by all)"""


def _proteins(spark, sf_dir) -> DataFrame:
    return composition.proteins(_seqs(spark, sf_dir), "label", aa="seq").withColumnRenamed("label", "target")


def _items(spark, sf_dir) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("").alias("source"), F.lit("").alias("lang"))
    return composition.proteins(composition.sequences(items), "label", aa="seq").withColumnRenamed("label", "query")


@query(
    f"""with {SHARED} select query, target, shared, rank::int as rank from (
    select *, row_number() over (partition by query order by shared desc, target) as rank from shared) where rank <= 5"""
)
def kmer_topk_candidates(spark, sf_dir):
    return homology.candidates(_items(spark, sf_dir), _proteins(spark, sf_dir)).select("query", "target", "shared", "rank")


@query(
    f"""with {SHARED}, f as (select query, arg_max(target, (shared, -target)) as target from shared group by query),
    b as (select target, arg_max(query, (shared, -query)) as query from shared group by target)
    select query, target, shared from f join b using (query, target) join shared using (query, target)"""
)
def reciprocal_best_hit(spark, sf_dir):
    return homology.reciprocal_best(_items(spark, sf_dir), _proteins(spark, sf_dir))


def aligned_items(spark, sf_dir) -> DataFrame:
    return homology.aligned_hits(_items(spark, sf_dir), _proteins(spark, sf_dir))


@query()
def local_alignment_hits(spark, sf_dir):
    return _rounded(homology.ortholog_calls(aligned_items(spark, sf_dir)), 6, "score", "identity", "query_coverage", "target_coverage")


# --- alignment columns -------------------------------------------------------------------------

CELLS = f"""{ROWS}, cells as (
  select gene, label, species, unnest(range(1, length(r) + 1))::int as col, unnest(string_split(r, '')) as ch from rws where length(r) > 0
)"""
HENIKOFF = """sizes as (select gene, count(*) as n_rows, max(length(r)) as n_cols from rws group by gene),
ends as (select gene, length(r) as l, count(*) as k from rws group by all),
per as (select gene, col, ch, count(*) as n from cells group by all),
there as (select gene, col, sum(n)::bigint as present, count(*) as kinds, coalesce(sum(n) filter (ch = '-'), 0)::bigint as gaps from per group by all),
of_col as (select gene, col, gaps + n_rows - present as all_gaps, kinds + (gaps = 0 and present < n_rows)::int as k from there join sizes using (gene)),
own as (select gene, label, sum(1.0::double / (k * case when c.ch = '-' then all_gaps else n end)) as own
  from cells c join per using (gene, col, ch) join of_col using (gene, col) group by all),
tails as (select gene, col, sum(case when all_gaps > 0 then 1.0::double / (k * all_gaps) else 0 end) over (partition by gene order by col desc) as tail from of_col),
raw_w as (select w.gene, w.label, coalesce(own, 0) + coalesce(tail, 0) as raw from rws w left join own using (gene, label)
  left join tails t on t.gene = w.gene and t.col = length(w.r) + 1),
weights as (select gene, label, raw / nullif(sum(raw) over (partition by gene), 0) as weight from raw_w)"""


@query(f"with {CELLS}, {HENIKOFF} select gene, label, round(weight, 6) as weight from weights")
def henikoff_weights(spark, sf_dir):
    return _rounded(conservation.henikoff_weights(_rows(spark, sf_dir)), 6, "weight")


COLS = """freq as (select gene, col, ch, count(*) as n, sum(weight) as w from cells join weights using (gene, label) where ch <> '-' group by all),
cols as (select gene, col, sum(n)::bigint as present, arg_max(ch, (n, -ascii(ch))) as consensus,
  greatest(0, log2(sum(w)) - sum(w * log2(w)) / sum(w)) as h from freq group by all),
scores as (select gene, col, 1 - present::double / n_rows as gap_fraction, consensus,
  case when present * 2 >= n_rows then case when h < 1e-9 then 0.0::double else h end end as entropy from cols join sizes using (gene))"""


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS} select gene, col, round(gap_fraction, 4) as gap_fraction, consensus,
    round(entropy, 4) + 0.0::double as entropy, round(1 - entropy / 2, 4) + 0.0::double as conservation from scores"""
)
def column_conservation(spark, sf_dir):
    return _rounded(conservation.conservation(_rows(spark, sf_dir)), 4, "gap_fraction", "entropy", "conservation")


@query(
    f"""with {ROWS}, firsts as (select gene, arg_min(r, label) as r from rws group by gene), c as (
      select gene, unnest(range(1, length(r) + 1))::int as col, unnest(string_split(r, '')) as ch from firsts where length(r) > 0)
    select gene, col, case when ch <> '-' then sum((ch <> '-')::int) over (partition by gene order by col)::double end as ref_position,
      case when ch <> '-' then ch else '' end as ref_letter from c"""
)
def reference_numbering(spark, sf_dir):
    return conservation.numbered(_rows(spark, sf_dir)).withColumn("ref_position", F.col("ref_position").cast("double"))


@query()
def extreme_windows(spark, sf_dir):
    """Windows as long as ``region_window`` has it for a gene's number of columns."""
    return _rounded(conservation.extreme_windows(conservation.conservation(_rows(spark, sf_dir))), 6, "mean_conservation")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS}, p as (select gene, col, ch, w / sum(w) over (partition by gene, col) as p from freq)
    select gene, col, round(2 + sum(p * log2(p)), 4) + 0.0::double as bits from p group by all"""
)
def information_content(spark, sf_dir):
    return _rounded(conservation.information(conservation.frequencies(_rows(spark, sf_dir))), 4, "bits")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS}, p as (select gene, col, ch, w / sum(w) over (partition by gene, col) as p from freq)
    select gene, col, ch, round(log2((p + 0.01) / 1.04 * 4), 3) + 0.0::double as score from p"""
)
def position_weights(spark, sf_dir):
    return _rounded(conservation.log_odds(conservation.frequencies(_rows(spark, sf_dir))), 3, "score")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS} select gene, count(entropy) as n_scored, count(*) filter (entropy <= 1e-9) as n_invariant,
    round(avg((entropy <= 1e-9)::int) filter (entropy is not null), 6) as invariant_fraction from scores group by gene"""
)
def invariant_fraction(spark, sf_dir):
    c = conservation.conservation(_rows(spark, sf_dir))
    same = F.when(F.col("entropy").isNotNull(), (F.col("entropy") <= 1e-9).cast("int"))
    out = c.groupBy("gene").agg(F.count("entropy").alias("n_scored"), F.count_if(F.col("entropy") <= 1e-9).alias("n_invariant"), F.avg(same).alias("invariant_fraction"))
    return _rounded(out, 6, "invariant_fraction")


@query(
    f"""with {SEQS} select label, len(regexp_extract_all(nt, 'GGTACC'))::int as n_hits,
    coalesce(nullif(strpos(nt, 'GGTACC'), 0), 0)::int as first_at from seqs"""
)
def motif_regex(spark, sf_dir):
    hits = F.size(F.regexp_extract_all("nt", F.lit("GGTACC"), F.lit(0)))
    return _seqs(spark, sf_dir).select("label", hits.alias("n_hits"), F.instr("nt", "GGTACC").alias("first_at"))


# --- distances, trees, splits ------------------------------------------------------------------

CONSENSUS = """taxa as (select species as grp, gene as taxon, col, arg_max(ch, (n, -ascii(ch))) as ch
  from (select species, gene, col, ch, count(*) as n from cells where ch <> '-' group by all) group by all)"""


@query(
    f"""with {CELLS}, {CONSENSUS}, pairs as (
      select x.grp, x.taxon as a, y.taxon as b, count(*) as valid,
        count(*) filter (x.ch <> y.ch and (x.ch in ('A', 'G')) = (y.ch in ('A', 'G'))) as ts,
        count(*) filter (x.ch <> y.ch and (x.ch in ('A', 'G')) <> (y.ch in ('A', 'G'))) as tv
      from taxa x join taxa y on x.grp = y.grp and x.col = y.col and x.taxon < y.taxon group by all),
    shares as (select *, ts::double / valid as p, tv::double / valid as q from pairs)
    select grp, a, b, valid, round(p + q, 6) as p,
      round(case when 1 - (p + q) * 4 / 3 > 1e-9 then 0.0::double - 0.75::double * ln(1 - (p + q) * 4 / 3) else 3 end, 6) as jc,
      round(case when 1 - 2 * p - q > 0 and 1 - 2 * q > 0 then 0.0::double - 0.5::double * ln(1 - 2 * p - q) - 0.25::double * ln(1 - 2 * q) else 3 end, 6) as k2p
    from shares"""
)
def pair_distances(spark, sf_dir):
    cons = distances.consensus(_rows(spark, sf_dir), "species", "gene")
    return _rounded(distances.distances(distances.pair_counts(cons)), 6, "p", "jc", "k2p")


@query()
def bootstrap_support(spark, sf_dir):
    cons = distances.consensus(_rows(spark, sf_dir), "species", "gene")
    splits = distances.tree_splits(distances.replicate_distances(cons, 100))
    return distances.support(splits, 100)


@query()
def tree_discordance(spark, sf_dir):
    cons = distances.consensus(_rows(spark, sf_dir), "species", "gene")
    s = distances.tree_splits(distances.replicate_distances(cons, 0))
    return _rounded(distances.robinson_foulds(s.filter("method = 'nj'"), s.filter("method = 'upgma'"), ["grp"]), 6, "nrf")


MASKS = """masks as (
  select distinct label, case when m % 2 = 1 then 255 - m else m end::bigint as split from (
    select label, list_sum(list_transform(range(1, 9), lambda i: (embedding[i] > 0)::bigint * (1 << (i - 1)))) as m from embeddings)
)"""


def _masks(spark, sf_dir) -> DataFrame:
    m = sum((F.when(F.col("embedding")[i] > 0, 1 << i).otherwise(0) for i in range(8)), F.lit(0)).cast("bigint")
    one = _table(spark, sf_dir, "embeddings").select("label", m.alias("m"))
    return one.select("label", F.when(F.col("m") % 2 == 1, 255 - F.col("m")).otherwise(F.col("m")).alias("split")).distinct()


@query(
    f"""with {MASKS}, p as (select x.label as one, y.label as other from (select distinct label from masks) x, (select distinct label from masks) y where x.label < y.label),
    j as (select one, other, count(*) as common from masks a join masks b using (split) join p on a.label = one and b.label = other group by all),
    n as (select label, count(*) as n from masks group by label)
    select one, other, (n1.n + n2.n - 2 * coalesce(common, 0))::bigint as rf,
      round((n1.n + n2.n - 2 * coalesce(common, 0))::double / (n1.n + n2.n), 6) as nrf
    from p join n n1 on one = n1.label join n n2 on other = n2.label left join j using (one, other)"""
)
def robinson_foulds(spark, sf_dir):
    m = _masks(spark, sf_dir)
    names = m.select("label").distinct()
    pairs = names.select(F.col("label").alias("one")).join(names.select(F.col("label").alias("other")), F.col("one") < F.col("other"))
    first = pairs.join(m, F.col("label") == F.col("one")).select("one", "other", "split")
    second = pairs.join(m, F.col("label") == F.col("other")).select("one", "other", "split")
    return _rounded(distances.robinson_foulds(first, second, ["one", "other"]), 6, "nrf")


@query(
    f"""with {MASKS} select x.label, count(*) as n_pairs, count(*) filter (
      x.split & y.split = 0 or x.split & (255 - y.split) = 0 or (255 - x.split) & y.split = 0 or (255 - x.split) & (255 - y.split) = 0) as n_compatible
    from masks x join masks y on x.label = y.label and x.split < y.split group by x.label"""
)
def split_compatibility(spark, sf_dir):
    """Pairs within a label are bounded: its distinct splits are at most 128, whatever the rows."""
    m = _masks(spark, sf_dir)
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("x.split") < F.col("y.split")))
    ok = distances.compatible(F.col("x.split"), F.col("y.split"), 8)
    return pairs.groupBy("x.label").agg(F.count("*").alias("n_pairs"), F.count_if(ok).alias("n_compatible"))


# --- selection ---------------------------------------------------------------------------------

PAIRS = "pair_table(x, y, sd, nd, s, n) as (values " + ", ".join(
    f"('{x}', '{y}', {sd!r}::double, {nd!r}::double, {s!r}::double, {n!r}::double)" for x, y, sd, nd, s, n in genetic_code.pair_rows()
) + ")"
CODON_COLS = f"""{SEQS}, {PAIRS}, every as (
  select gene, species, unnest(regexp_extract_all(nt, '...')) as codon, unnest(range(len(regexp_extract_all(nt, '...')))) as col from seqs
)"""
WITHIN = f"""{CODON_COLS}, counts as (select gene, col, codon, count(*) as k from every where codon not in ('TAA', 'TAG', 'TGA') group by all),
met as (select a.gene, a.col, a.codon as x, b.codon as y, case when a.codon = b.codon then a.k * (a.k - 1) / 2 else a.k * b.k end as pairs
  from counts a join counts b on a.gene = b.gene and a.col = b.col and a.codon <= b.codon),
totals as (select gene, col, sum(pairs * sd) as sd, sum(pairs * nd) as nd, sum(pairs * s) as s, sum(pairs * n) as n
  from met join pair_table using (x, y) where pairs > 0 group by all)"""
ESTIMATE = """select {0}, round(ps + 1e-9, 6) as ps, round(pn + 1e-9, 6) as pn, round(ds, 5) as ds, round(dn, 5) as dn,
  round(case when ds > 0 and not ps > 0.6 then dn / ds end, 5) as omega, coalesce(ps > 0.6, false) as saturated
from (select *, case when ps < 0.749999999 then 0.0::double - 0.75::double * ln(1 - ps * 4 / 3) end as ds, case when pn < 0.749999999 then 0.0::double - 0.75::double * ln(1 - pn * 4 / 3) end as dn
  from (select {0}, sum(sd) / nullif(sum(s), 0) as ps, sum(nd) / nullif(sum(n), 0) as pn from {1} group by {0}))"""


def _estimates(df: DataFrame) -> DataFrame:
    """Rounded; shares are often short binary fractions, so they are first moved off the middle between two."""
    df = df.withColumns({c: F.col(c) + 1e-9 for c in ("ps", "pn")})
    return _rounded(_rounded(df, 6, "ps", "pn"), 5, "ds", "dn", "omega")


@query(
    f"""with {CODE}, n as (select codon, aa, i, b, codon[1:i - 1] || b || codon[i + 1:3] as other
      from code, range(1, 4) t(i), (values ('T'), ('C'), ('A'), ('G')) u(b) where aa <> '*' and codon[i:i] <> b)
    select n.codon, round(count(*) filter (o.aa = n.aa) / 3.0::double, 6) as s, round(3 - count(*) filter (o.aa = n.aa) / 3.0::double, 6) as n
    from n join code o on o.codon = n.other group by n.codon"""
)
def codon_sites(spark, sf_dir):
    rows = [(c, round(genetic_code.sites(c), 6), round(3 - genetic_code.sites(c), 6)) for c in genetic_code.SENSE]
    return spark.createDataFrame(rows, "codon string, s double, n double")


@query(f"with {WITHIN} {ESTIMATE.format('gene', 'totals')}")
def dnds_within(spark, sf_dir, seqs=_seqs):
    return _estimates(selection.estimate(selection.within_columns(seqs(spark, sf_dir), "gene"), ["gene"]))


@query(
    f"""with {CODON_COLS}, counts as (select gene, species, col, codon, count(*) as k from every where codon not in ('TAA', 'TAG', 'TGA') group by all),
    met as (select a.gene, a.species as one, b.species as other, a.col, least(a.codon, b.codon) as x, greatest(a.codon, b.codon) as y, a.k * b.k as pairs
      from counts a join counts b on a.gene = b.gene and a.col = b.col and a.species < b.species),
    totals as (select gene, one, other, col, sum(pairs * sd) as sd, sum(pairs * nd) as nd, sum(pairs * s) as s, sum(pairs * n) as n
      from met join pair_table using (x, y) group by all)
    {ESTIMATE.format('gene, one, other', 'totals')}"""
)
def dnds_between(spark, sf_dir, seqs=_seqs):
    totals = selection.between_columns(seqs(spark, sf_dir), ["gene"], "species")
    return _estimates(selection.estimate(totals, ["gene", "one", "other"]))


@query(
    f"""with {WITHIN}, ends as (select gene, max(col) + 1 as length from totals group by gene),
    spread as (select t.*, s.start from totals t join ends using (gene), lateral (select unnest(range(0, t.col + 1, 20)) as start) s
      where t.col < s.start + 60 and (s.start = 0 or s.start + 60 <= length))
    {ESTIMATE.format('gene, start', 'spread')}""".replace("select gene, start, round", "select gene, start::int as start, round")
)
def dnds_windows(spark, sf_dir, seqs=_seqs):
    totals = selection.within_columns(seqs(spark, sf_dir), "gene")
    return _estimates(selection.windows(totals, ["gene"]))


WEIGHT = "list_sum(list_transform([368, 736, 920, 981, 996, 999], lambda b: (('0x' || substring(md5({0}), 1, 8))::bigint % 1000 >= b)::int))"


@query(
    f"""with {WITHIN}, drawn as (select gene, rep, sd * w as sd, nd * w as nd, s * w as s, n * w as n
      from (select *, {WEIGHT.format("rep || ':' || col")} as w from totals, range(1, 51) t(rep)) where w > 0),
    est as ({ESTIMATE.format('gene, rep', 'drawn').replace('not ps > 0.6', 'true').replace('round(case when ds > 0 and true then dn / ds end, 5)', 'case when ds > 0 then dn / ds end')})
    select gene, case when count(omega) >= 25 then round(quantile_cont(omega, 0.025), 4) end as lo,
      case when count(omega) >= 25 then round(quantile_cont(omega, 0.975), 4) end as hi, count(omega) as n_finite from est group by gene"""
)
def dnds_bootstrap(spark, sf_dir):
    totals = selection.within_columns(_seqs(spark, sf_dir), "gene")
    return _rounded(selection.bootstrap(totals, ["gene"], 50), 4, "lo", "hi")


# --- statistics --------------------------------------------------------------------------------


def _two_classes(spark, sf_dir) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label"), (F.col("quality") == 0).alias("first"))
    m = sequence_metrics(spark, sf_dir).join(labels, "label")
    return m.unpivot(["label", "first"], ["gc", "gc3", "gc_skew"], "metric", "value")


CLASSES = f"""{SEQS}, m as ({_METRICS}), classes as (
  select label, quality = 0 as first, metric, value from (unpivot (select m.label, quality, gc, gc3, gc_skew from m join labels on doc_id = m.label) on gc, gc3, gc_skew into name metric value value)
  where value is not null
)"""
UTEST = """v as (select metric, value, count(*) filter (first) as n1, count(*) filter (not first) as n2 from classes group by all),
c as (select *, sum(n2) over (partition by metric order by value) - n2 as below2 from v),
tests as (select metric, sum(n1)::bigint as n1, sum(n2)::bigint as n2, sum(n1 * (below2 + n2 / 2.0::double))::double as u,
  sum(((n1 + n2) ^ 3 - (n1 + n2))::double) as ties from c group by metric)"""


@query(f"with {CLASSES}, {UTEST} select metric, n1, n2, round(u, 3) as u, round(2 * u / (n1 * n2) - 1, 6) as delta, round(ties, 1) as ties from tests")
def rank_tests(spark, sf_dir):
    t = statistics.rank_test(_two_classes(spark, sf_dir), ["metric"])
    return _rounded(_rounded(_rounded(t, 3, "u"), 6, "delta"), 1, "ties")


@query()
def group_comparison(spark, sf_dir):
    """Each metric's two groups: sizes, medians, U and its p and q, and intervals of the differences of means and medians and of delta."""
    values = written(_two_classes(spark, sf_dir))
    t = statistics.with_p(statistics.rank_test(values, ["metric"]))
    whole = statistics.adjusted(t).join(statistics.medians(values, ["metric"]), "metric")
    ci = statistics.resampled_difference(values, ["metric"], 5000).join(statistics.resampled_statistics(values, ["metric"]), "metric")
    names = ("delta", "p", "q", "median1", "median2", "median_difference", "difference", "lo", "hi", "median_lo", "median_hi", "delta_lo", "delta_hi")
    return _rounded(tables.significant(whole.join(ci, "metric")), 6, *names)


@query(
    f"""with {CLASSES} select metric, round(median(value) filter (first), 6) as median1, round(median(value) filter (not first), 6) as median2,
    round(median(value) filter (first) - median(value) filter (not first), 6) as median_difference from classes group by metric"""
)
def median_difference(spark, sf_dir):
    return _rounded(statistics.medians(_two_classes(spark, sf_dir), ["metric"]), 6, "median1", "median2", "median_difference")


@query(
    f"""with {CLASSES}, d as (select metric, rep, sum(w * value) filter (first) / nullif(sum(w) filter (first), 0)
        - sum(w * value) filter (not first) / nullif(sum(w) filter (not first), 0) as d
      from (select *, case when rep = 0 then 1 else {WEIGHT.format("rep || ':' || label")} end as w from classes, range(0, 51) t(rep)) group by all)
    select metric, round(max(d) filter (rep = 0), 5) as difference, round(quantile_cont(d, 0.025) filter (rep > 0), 5) as lo,
      round(quantile_cont(d, 0.975) filter (rep > 0), 5) as hi from d group by metric"""
)
def bootstrap_interval(spark, sf_dir):
    return _rounded(statistics.mean_difference_interval(_two_classes(spark, sf_dir), ["metric"], "label", 50), 5, "difference", "lo", "hi")


@query(
    f"""with {SEQS}, m as ({_METRICS}), g as (select gene, round(avg(gc), 6) as p from m group by gene),
    r as (select *, row_number() over (order by p) as rank, count(*) over () as n from g)
    select gene, p, round(least(1, min(p * n / rank) over (order by rank desc)), 6) as q from r"""
)
def bh_qvalues(spark, sf_dir):
    p = _rounded(sequence_metrics(spark, sf_dir).groupBy("gene").agg(F.avg("gc").alias("p")), 6, "p")
    return _rounded(statistics.adjusted(p), 6, "q")


@query(
    f"""with {SEQS}, m as (select * from ({_METRICS}) where gc is not null and gc3 is not null), r as (
      select rank() over (order by gc) + (count(*) over (partition by gc) - 1) / 2.0::double as x,
        rank() over (order by gc3) + (count(*) over (partition by gc3) - 1) / 2.0::double as y from m)
    select count(*) as n, round(corr(x, y), 6) as rho from r"""
)
def spearman_rho(spark, sf_dir):
    return _rounded(statistics.spearman(sequence_metrics(spark, sf_dir), "gc", "gc3"), 6, "rho")


# --- structure ---------------------------------------------------------------------------------

POINTS = "points as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"
DISTANT = f"""{POINTS}, centre as (select avg(x) as cx, avg(y) as cy, avg(z) as cz from points),
d as (select vec_id, label, x, y, z, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) as distance from points, centre)"""


def _points(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def _distant(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir)
    return structure.distance_to_centre(p, structure.centroid(p))


@query(f"with {DISTANT} select vec_id, round(distance, 6) as distance from d")
def centroid_distance(spark, sf_dir):
    return _rounded(_distant(spark, sf_dir).select("vec_id", "distance"), 6, "distance")


@query(
    f"""with {DISTANT} select count(*) filter (distance <= 1) as n_near, round(avg(z) filter (distance <= 1), 5) as mean_near,
    count(*) filter (distance > 1) as n_far, round(avg(z) filter (distance > 1), 5) as mean_far from d"""
)
def near_far_means(spark, sf_dir):
    return _rounded(structure.near_and_far(_distant(spark, sf_dir), "z", 1.0), 5, "mean_near", "mean_far")


@query(f"with {DISTANT} select floor(distance / 0.25)::bigint as bin, count(*) as n, round(avg(z), 5) as mean from d group by all")
def binned_mean(spark, sf_dir):
    return _rounded(structure.binned(_distant(spark, sf_dir), "distance", "z", 0.25), 5, "mean")


@query(
    f"""with {POINTS} select least(floor((x + 3) / 6 * 24), 23)::bigint as bx, least(floor((y + 3) / 6 * 24), 23)::bigint as by, count(*) as n
    from points where x between -3 and 3 and y between -3 and 3 group by all"""
)
def hist2d(spark, sf_dir):
    return structure.histogram2d(_points(spark, sf_dir), "x", "y", -3.0, 3.0, 24).select(F.col("bx").cast("bigint"), F.col("by").cast("bigint"), "n")


def _product(a: str, b: str) -> str:
    return "({a}y * {b}z - {a}z * {b}y) as {a}{b}x, ({a}z * {b}x - {a}x * {b}z) as {a}{b}y, ({a}x * {b}y - {a}y * {b}x) as {a}{b}z".format(a=a, b=b)


DIHEDRALS = f"""{POINTS}, q as (select vec_id, label, {", ".join(f"lead({c}, {i + 1}) over w - lead({c}, {i}) over w as {v}{c}" for i, v in enumerate("uvw") for c in "xyz")}
  from points window w as (partition by label order by vec_id)),
n as (select *, {_product("u", "v")}, {_product("v", "w")} from q),
t as (select *, (uvy * vwz - uvz * vwy) * vx + (uvz * vwx - uvx * vwz) * vy + (uvx * vwy - uvy * vwx) * vz as top, uvx * vwx + uvy * vwy + uvz * vwz as bottom from n),
angles as (select vec_id, label, degrees(atan2(top / sqrt(vx * vx + vy * vy + vz * vz), bottom)) as dihedral from t)"""


@query(f"with {DIHEDRALS} select vec_id, label, round(dihedral, 4) as dihedral from angles")
def dihedral_angles(spark, sf_dir):
    return _rounded(structure.chain_dihedrals(_points(spark, sf_dir), "label", "vec_id").select("vec_id", "label", "dihedral"), 4, "dihedral")


@query(
    f"""with {DIHEDRALS}, p as (select dihedral as phi, lead(dihedral) over (partition by label order by vec_id) as psi from angles),
    r as (select case when phi < 0 and psi > -120 and psi < 50 then 'alpha' when phi < 0 and (psi >= 50 or psi <= -150) then 'beta'
      when phi >= 0 then 'left-handed' else 'other' end as region from p where phi is not null and psi is not null)
    select region, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from r group by region"""
)
def case_regions(spark, sf_dir):
    from pyspark.sql import Window

    d = structure.chain_dihedrals(_points(spark, sf_dir), "label", "vec_id")
    p = d.select(F.col("dihedral").alias("phi"), F.lead("dihedral").over(Window.partitionBy("label").orderBy("vec_id")).alias("psi"))
    named = p.filter("phi is not null and psi is not null").select(structure.region(F.col("phi"), F.col("psi")).alias("region"))
    return _rounded(tables.shares(named, "region"), 6, "share")


# --- plain tables ------------------------------------------------------------------------------


@query(
    """select event_id, user_id, round(case when count(value) over w >= 7 then avg(value) over w end, 6) as rolling from events
    window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)"""
)
def rolling_min_periods(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return _rounded(conservation.rolling(e, ["user_id"], ["ts", "event_id"], "value", 10, 7).select("event_id", "user_id", "rolling"), 6, "rolling")


@query(
    """select event_id, user_id, round(case when count(value) over w >= 5 then avg(value) over w end, 6) as rolling from events
    window w as (partition by user_id order by ts, event_id rows between 7 preceding and 7 following)"""
)
def rolling_centred(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return _rounded(conservation.rolling(e, ["user_id"], ["ts", "event_id"], "value", 15, 5, centred=True).select("event_id", "user_id", "rolling"), 6, "rolling")


@query(
    """with r as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as a,
      row_number() over (partition by user_id, event_type order by ts, event_id) as b from events)
    select user_id, event_type, min(a)::int as start, count(*) as n from r group by user_id, event_type, a - b"""
)
def runs_islands(spark, sf_dir):
    return tables.runs(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("select o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey")
def representatives(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.first_of(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    """select c_mktsegment as segment, """
    + ", ".join(f"round(avg(c_acctbal) filter (n_regionkey = {i}), 4) as r{i}" for i in range(5))
    + " from customer join nation on c_nationkey = n_nationkey group by all"
)
def class_means_pivot(spark, sf_dir):
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("r"), "n_regionkey").alias("r"), "c_acctbal")
    names = [f"r{i}" for i in range(5)]
    return _rounded(j.groupBy("segment").pivot("r", names).agg(F.avg("c_acctbal")), 4, *names)


@query("select l_returnflag, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from lineitem group by all")
def value_counts_normalized(spark, sf_dir):
    return _rounded(tables.shares(_table(spark, sf_dir, "lineitem").select("l_returnflag"), "l_returnflag"), 6, "share")


@query(
    """select c_custkey, round((c_acctbal - avg(c_acctbal) over w) / nullif(stddev_pop(c_acctbal) over w, 0), 5) as z from customer
    window w as (partition by c_mktsegment)"""
)
def zscore(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _rounded(tables.standardised(c, "c_mktsegment", "c_acctbal").select("c_custkey", "z"), 5, "z")


@query(
    """select l_orderkey, l_linenumber, name, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem)
    on l_quantity, l_discount, l_tax into name name value value)"""
)
def unpivot(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def left_semi_filter(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query(
    f"""with {SEQS}, m as ({_METRICS}) select 'gc' as module, gene, round(avg(gc), 4) as value from m group by gene
    union all select 'gc3', gene, round(avg(gc3), 4) from m group by gene union all select 'length', gene, round(avg(length), 4) from m group by gene"""
)
def union_modules(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir)
    long = m.select("gene", "gc", "gc3", F.col("length").cast("double").alias("length")).unpivot("gene", ["gc", "gc3", "length"], "module", "value")
    return _rounded(long.groupBy("module", "gene").agg(F.avg("value").alias("value")), 4, "value")


# --- further views of the same operators --------------------------------------------------------


@query(f"with {SEQS} select label, round({GC.format('nt')}, 6) as gc from seqs")
def gc_content(spark, sf_dir):
    return _rounded(_seqs(spark, sf_dir).select("label", sequence.gc_fraction(F.col("nt")).alias("gc")), 6, "gc")


@query(f"with {SEQS}, m as ({_METRICS}) select label, gc_skew from m")
def gc_skew(spark, sf_dir):
    return _rounded(_seqs(spark, sf_dir).select("label", sequence.gc_skew(F.col("nt")).alias("gc_skew")), 6, "gc_skew")


@query(f"with {SEQS}, m as ({_METRICS}) select label, gc1, gc2, gc3 from m")
def gc_by_codon_position(spark, sf_dir):
    return sequence_metrics(spark, sf_dir).select("label", "gc1", "gc2", "gc3")


@query(
    f"""with {SEQS}, {PROTEINS}, kept as (select aa, min(label) as label, count(*) as n from proteins where length(aa) > 0 group by aa)
    select label, n as n_copies, length(aa)::int as length from kept"""
)
def family_hits_dedup(spark, sf_dir):
    """One record for each distinct translation, the first by label; copies are counted map-side, by digest."""
    p = _proteins(spark, sf_dir).filter("seq <> ''").select("target", F.sha2(F.col("seq").cast("binary"), 256).alias("d"), F.length("seq").alias("length"))
    return p.groupBy("d", "length").agg(F.min("target").alias("label"), F.count("*").alias("n_copies")).select("label", "n_copies", "length")


@query("select l_orderkey, arg_min(l_partkey, (l_shipdate, l_linenumber)) as l_partkey from lineitem group by l_orderkey")
def first_by_coordinate(spark, sf_dir):
    """Of lines with the same date and number the one that the table has first, as ``arg_min`` keeps it where one thread reads.

    As there, a line without a part counts only where an order has no other, and unknown dates and numbers come last.
    """
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", *place)
    order = [F.isnull("l_partkey"), F.asc_nulls_last("l_shipdate"), F.asc_nulls_last("l_linenumber"), "file", "at"]
    return tables.first_of(rows, "l_orderkey", order).select("l_orderkey", "l_partkey")


@query(
    f"""with {CELLS}, {CONSENSUS} select x.grp, x.taxon as a, y.taxon as b, round(100.0::double * count(*) filter (x.ch = y.ch) / count(*), 4) as identity
    from taxa x join taxa y on x.grp = y.grp and x.col = y.col and x.taxon < y.taxon group by all"""
)
def pairwise_identity_ungapped(spark, sf_dir):
    counts = distances.pair_counts(distances.consensus(_rows(spark, sf_dir), "species", "gene"))
    out = counts.select("grp", "a", "b", (100 * (F.col("valid") - F.col("ts") - F.col("tv")) / F.col("valid")).alias("identity"))
    return _rounded(out, 4, "identity")


@query()
def nj_splits(spark, sf_dir):
    cons = distances.consensus(_rows(spark, sf_dir), "species", "gene")
    return distances.tree_splits(distances.replicate_distances(cons, 0), ("nj",)).select("grp", "split")


@query()
def upgma_splits(spark, sf_dir):
    cons = distances.consensus(_rows(spark, sf_dir), "species", "gene")
    return distances.tree_splits(distances.replicate_distances(cons, 0), ("upgma",)).select("grp", "split")


@query(
    f"""with {MASKS}, s as (select label, case when split & 2 = 2 then (split & 62) # 62 else split & 62 end as split from masks)
    select distinct label, split from s where bit_count(split) >= 2 and 5 - bit_count(split) >= 2""".replace("(split & 62) # 62", "xor(split & 62, 62::bigint)")
)
def split_restrict(spark, sf_dir):
    return distances.restricted(_masks(spark, sf_dir), 62, ["label"])


@query(
    "select x, y, round(sd, 6) as sd, round(nd, 6) as nd from (" + f"with {PAIRS} select * from pair_table)"
)
def codon_differences(spark, sf_dir):
    return _rounded(genetic_code.pair_table(spark).select("x", "y", "sd", "nd"), 6, "sd", "nd")


@query(
    f"""with {WITHIN}, drawn as (select gene, rep, sd * w as sd, nd * w as nd, s * w as s, n * w as n
      from (select *, {WEIGHT.format("rep || ':' || col")} as w from totals, range(1, 51) t(rep)) where w > 0),
    est as ({ESTIMATE.format('gene, rep', 'drawn').replace('not ps > 0.6', 'true').replace('round(case when ds > 0 and true then dn / ds end, 5)', 'case when ds > 0 then dn / ds end')}),
    pooled as (select rep, sd, nd, s, n from drawn where gene in ('src0', 'src1', 'src2', 'src3')),
    ctl as (select rep, case when ds > 0 then dn / ds end as c from (select rep, case when ps < 0.749999999 then 0.0::double - 0.75::double * ln(1 - ps * 4 / 3) end as ds,
        case when pn < 0.749999999 then 0.0::double - 0.75::double * ln(1 - pn * 4 / 3) end as dn from (select rep, sum(sd) / nullif(sum(s), 0) as ps, sum(nd) / nullif(sum(n), 0) as pn from pooled group by rep))),
    r as (select gene, omega / c as ratio from est join ctl using (rep) where gene not in ('src0', 'src1', 'src2', 'src3') and omega is not null and c is not null)
    select gene, round(quantile_cont(ratio, 0.025), 4) as lo, round(quantile_cont(ratio, 0.975), 4) as hi,
      round(least(1, greatest(1.0::double / count(*), 2 * least(avg((ratio <= 1)::int), avg((ratio >= 1)::int)))), 6) as p from r group by gene"""
)
def gene_vs_controls(spark, sf_dir):
    """Each gene's omega over that of four pooled control genes, in paired replicates that redraw codon columns."""
    totals = selection.within_columns(_seqs(spark, sf_dir), "gene")
    return _rounded(_rounded(selection.against_controls(totals, "gene", [f"src{i}" for i in range(4)], 50), 4, "lo", "hi"), 6, "p")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS} select gene, col, ch, round(w / sum(w) over (partition by gene, col), 4) as freq from freq"""
)
def position_frequencies(spark, sf_dir):
    return _rounded(conservation.frequencies(_rows(spark, sf_dir)), 4, "freq")


@query(
    f"""with {CELLS}, {HENIKOFF}, {COLS}, v as (select gene, col, round(1 - entropy / 2, 6) as c from scores where entropy is not null),
    d as (select gene, c, count(*) as n from v group by all),
    o as (select gene, c, n, sum(n) over (partition by gene order by c desc) - n as greater, sum(n) over (partition by gene) as total from d)
    select gene, c as conservation, round(100.0::double * (greater + n / 2.0::double) / total, 4) as midrank, n,
      round(100.0::double * greater / total, 4) as strict, round(100.0::double * (greater + n) / total, 4) as worst from o"""
)
def midrank_percentile(spark, sf_dir):
    """Share of a gene's columns that are conserved better, ties half, not at all or whole, for every distinct value."""
    c = conservation.conservation(_rows(spark, sf_dir)).filter("conservation is not null")
    return _rounded(statistics.midranks(c, "gene", "conservation", 6), 4, "midrank", "strict", "worst")


@query()
def principal_axes(spark, sf_dir):
    axes = structure.principal_axes(_points(spark, sf_dir))
    return spark.createDataFrame([(i, *(round(float(x), 6) for x in a)) for i, a in enumerate(axes)], "axis int, x double, y double, z double")


@query(f"with {CLASSES}, {UTEST} select metric, round(2 * u / (n1 * n2) - 1, 6) as delta from tests")
def cliffs_delta(spark, sf_dir):
    return rank_tests(spark, sf_dir).select("metric", "delta")


@query()
def effect_table(spark, sf_dir):
    """Effect sizes of all metrics in a fixed order, as a forest plot reads them."""
    order = spark.createDataFrame([(i, m) for i, m in enumerate(("gc", "gc3", "gc_skew"))], "ord int, metric string")
    found = group_comparison(spark, sf_dir).select("metric", "n1", "n2", "median1", "median2", "delta", "delta_lo", "delta_hi", "p", "q", "significant")
    return order.join(found, "metric", "left").orderBy("ord")


@query()
def omega_recovery(spark, sf_dir):
    """True and estimated omega of simulated genes; takes no table."""
    from ..sources import synthetic

    panel = synthetic.star_panel(spark, 14, 6, 200, [0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0], seed=7)
    est = selection.estimate(selection.within_columns(panel, "gene"), ["gene"])
    truth = panel.select("gene", F.col("omega").alias("true_omega")).distinct()
    return _rounded(truth.join(est.select("gene", F.col("omega").alias("estimated_omega"), "ps"), "gene"), 6, "estimated_omega", "ps")


@query(
    f"""with {SEQS}, m as ({_METRICS}) select gene, species, count(*) as n_sequences, round(median(gc), 6) as median_gc, round(min(gc3), 6) as min_gc3,
    round(max(gc3), 6) as max_gc3 from m where gene = 'src1' group by gene, species"""
)
def gene_view(spark, sf_dir):
    m = sequence_metrics(spark, sf_dir).filter(F.col("gene") == "src1")
    out = m.groupBy("gene", "species").agg(F.count("*").alias("n_sequences"), F.median("gc").alias("median_gc"), F.min("gc3").alias("min_gc3"), F.max("gc3").alias("max_gc3"))
    return _rounded(out, 6, "median_gc", "min_gc3", "max_gc3")
