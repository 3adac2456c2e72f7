"""Synonymous and other changes (Nei-Gojobori) pooled over all pairs of sequences.

Pairs are never made.  In a codon column n sequences with codon x and m with y
are n * m pairs of the same outcome, and a column has 61 codons at most; so the
sums over pairs come from counts by column, at a cost that doesn't depend on how
many sequences there are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genetic_code, sequence
from .blocks import Block, per_block, repeated
from .composition import numbered
from .conservation import counted

SUMS = ("sd", "nd", "s", "n")


def _lettered(batches):
    """Rows of codons as rows of one sign for each; a codon with another letter than the four bases is a gap."""
    for b in batches:
        at = b.schema.get_field_index("nt")
        for some in (b.slice(i, 1_000) for i in range(0, b.num_rows, 1_000)):
            numbers = (numbered(nt.as_py() or "") for nt in some.column("nt"))
            rows = [np.where(x < 64, 48 + x, ord("-")).astype(np.uint8).tobytes().decode("ascii") for x in numbers]
            yield some.set_column(at, pa.field("row", pa.string()), pa.array(rows, pa.string()))


def codon_columns(seqs: DataFrame, *by: str) -> DataFrame:
    """(by, col, codon, k): how many sequences have a sense codon in a column, columns from 0.

    Codons become signs, whose columns each task counts in arrays: what is shuffled
    are counts by column and never codons.
    """
    rows = _lettered_rows(seqs, *by)
    codon = F.create_map(*(F.lit(x) for sign, c in _SIGNS.items() if c in genetic_code.SENSE for x in (sign, c)))
    found = counted(rows, *by).select(*by, (F.col("col") - 1).alias("col"), F.try_element_at(codon, F.col("ch")).alias("codon"), F.col("n").alias("k"))
    return found.filter("codon is not null")


def _summed(pairs: DataFrame, by: list[str]) -> DataFrame:
    table = F.broadcast(genetic_code.pair_table(pairs.sparkSession))
    met = pairs.withColumn("lo", F.least("cx", "cy")).withColumn("hi", F.greatest("cx", "cy"))
    joined = met.join(table, (F.col("lo") == F.col("x")) & (F.col("hi") == F.col("y")))
    return joined.groupBy(*by, "col").agg(*(F.sum(F.col("pairs") * F.col(c)).alias(c) for c in SUMS), F.sum("pairs").alias("pairs"))


def within(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, col, sd, nd, s, n, pairs): sums over all unordered pairs of sequences of one group."""
    x = counts.select(*by, "col", F.col("codon").alias("cx"), F.col("k").alias("kx"))
    y = counts.select(*by, "col", F.col("codon").alias("cy"), F.col("k").alias("ky"))
    pairs = F.when(F.col("cx") == F.col("cy"), F.col("kx") * (F.col("kx") - 1) / 2).otherwise(F.col("kx") * F.col("ky"))
    both = x.join(y, [*by, "col"]).filter("cx <= cy").withColumn("pairs", pairs).filter("pairs > 0")
    return _summed(both, by)


def between(counts: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by, one, other, col, ...): sums over pairs of sequences of two groups, ``one`` < ``other``."""
    x = counts.select(*by, F.col(group).alias("one"), "col", F.col("codon").alias("cx"), F.col("k").alias("kx"))
    y = counts.select(*by, F.col(group).alias("other"), "col", F.col("codon").alias("cy"), F.col("k").alias("ky"))
    both = x.join(y, [*by, "col"]).filter("one < other").withColumn("pairs", F.col("kx") * F.col("ky"))
    return _summed(both, [*by, "one", "other"])


#: Columns of codons that are summed at once: each has 61 counts.
CODON_BLOCK = 512
_SIGNS = {chr(48 + 16 * i + 4 * j + k): x + y + z for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for k, z in enumerate("TCAG")}


@lru_cache
def _tables() -> np.ndarray:
    """``SUMS`` of each two sense codons, one table behind the other; rows and columns in the order of ``SENSE``."""
    at = {c: i for i, c in enumerate(genetic_code.SENSE)}
    out = np.zeros((len(SUMS), len(at), len(at)))
    for x, y, *values in genetic_code.pair_rows():
        out[:, at[x], at[y]] = out[:, at[y], at[x]] = values
    return out


def _codon_numbers(block: Block) -> np.ndarray:
    """How many sequences have each sense codon in each column of a block."""
    none = np.zeros(block.size, np.int64)
    sign = {c: s for s, c in _SIGNS.items()}
    return np.stack([block.counts.get(sign[c], (none,))[0] for c in genetic_code.SENSE]).T.astype(float)


def _lettered_rows(seqs: DataFrame, *names: str) -> DataFrame:
    kinds = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in names)
    return seqs.select(*names, "nt").mapInArrow(_lettered, f"{kinds}row string")


def within_columns(seqs: DataFrame, *by: str) -> DataFrame:
    """``within`` of the codons of ``seqs``: a block's counts become sums in one place, as products of matrices."""

    def finish(group: tuple, at: int, found: dict[tuple, Block]) -> pa.RecordBatch:
        k = _codon_numbers(found[()])
        pairs = k.sum(axis=1) * (k.sum(axis=1) - 1) / 2
        sums = [(((k @ m) * k).sum(axis=1) - k @ np.diag(m)) / 2 for m in _tables()]
        col = np.flatnonzero(pairs)
        return pa.RecordBatch.from_arrays([*repeated(group, len(col)), pa.array(at * CODON_BLOCK + col), *(pa.array(x[col]) for x in (*sums, pairs))], names=[*by, "col", *SUMS, "pairs"])

    kinds = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in by)
    return per_block(_lettered_rows(seqs, *by), list(by), [], finish, f"{kinds}col int, sd double, nd double, s double, n double, pairs double", size=CODON_BLOCK)


def between_columns(seqs: DataFrame, by: list[str], group: str) -> DataFrame:
    """``between`` of the codons of ``seqs``; the groups of a block meet in one place."""

    def finish(of: tuple, at: int, found: dict[tuple, Block]) -> pa.RecordBatch | None:
        counts = {g: _codon_numbers(block) for (g,), block in sorted((x for x in found.items() if x[0][0] is not None), key=lambda x: x[0])}
        names, out = list(counts), []
        for i, one in enumerate(names):
            each = [counts[one] @ m for m in _tables()]
            for other in names[i + 1 :]:
                k = counts[other]
                pairs = counts[one].sum(axis=1) * k.sum(axis=1)
                col = np.flatnonzero(pairs)
                sums = [(x * k).sum(axis=1)[col] for x in each]
                out.append(pa.RecordBatch.from_arrays([*repeated((*of, one, other), len(col)), pa.array(at * CODON_BLOCK + col), *map(pa.array, (*sums, pairs[col].astype(np.int64)))], names=[*by, "one", "other", "col", *SUMS, "pairs"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(len(x) for x in out) else None

    kinds = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in by)
    kind = seqs.schema[group].dataType.simpleString()
    schema = f"{kinds}one {kind}, other {kind}, col int, sd double, nd double, s double, n double, pairs bigint"
    return per_block(_lettered_rows(seqs, *by, group), by, [group], finish, schema, size=CODON_BLOCK)


def jukes_cantor(p: Column) -> Column:
    """Null from a share of 0.75 on, unlike the capped distance of trees."""
    return sequence.jukes_cantor(p, None)


def estimate(totals: DataFrame, by: list[str], saturated: float = 0.6) -> DataFrame:
    """(by, ps, pn, ds, dn, omega, saturated): omega is withheld without synonymous change or with too much."""
    sums = totals.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))
    ps, pn = F.col("sd") / F.nullif("s", F.lit(0.0)), F.col("nd") / F.nullif("n", F.lit(0.0))
    out = sums.select(*by, ps.alias("ps"), pn.alias("pn")).select("*", jukes_cantor(F.col("ps")).alias("ds"), jukes_cantor(F.col("pn")).alias("dn"))
    full = F.coalesce(F.col("ps") > saturated, F.lit(False))
    return out.select("*", F.when((F.col("ds") > 0) & ~full, F.col("dn") / F.col("ds")).alias("omega"), full.alias("saturated"))


def in_windows(totals: DataFrame, by: list[str], width: int = 60, step: int = 20) -> DataFrame:
    """``totals`` with the ``start`` of each window that a column lies in, width / step of them."""
    last = totals.groupBy(*by).agg((F.max("col") + 1).alias("length"))
    first = F.greatest(F.lit(0), F.floor((F.col("col") - width) / step).cast("int") + 1) * step
    starts = F.sequence(first, F.floor(F.col("col") / step).cast("int") * step, F.lit(step))
    spread = totals.join(last, by).withColumn("start", F.explode(starts))
    return spread.filter("start = 0 or start + %d <= length" % width)


def windows(totals: DataFrame, by: list[str], width: int = 60, step: int = 20) -> DataFrame:
    """(by, start, ...): estimates of sliding windows of codon columns."""
    return estimate(in_windows(totals, by, width, step), [*by, "start"])


def replicate_weight(rep: Column, key: Column) -> Column:
    """Poisson draws with mean 1 (to three decimals) from an MD5 hash, the same in any engine."""
    u = F.conv(F.substring(F.md5(F.concat(rep.cast("string"), F.lit(":"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % 1000
    weight = F.lit(0)
    for bound in (368, 736, 920, 981, 996, 999):
        weight = weight + (u >= bound).cast("int")
    return weight


def bootstrap(totals: DataFrame, by: list[str], replicates: int = 200) -> DataFrame:
    """(by, lo, hi, n_finite): 2.5 and 97.5 percent quantiles of omega over replicates that redraw columns."""
    reps = totals.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = replicate_weight(F.col("rep"), F.col("col"))
    drawn = reps.withColumn("w", w).filter("w > 0").select(*by, "rep", *((F.col(c) * F.col("w")).alias(c) for c in SUMS))
    est = estimate(drawn, [*by, "rep"], saturated=1.0)
    q = est.groupBy(*by).agg(F.percentile("omega", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("omega").alias("n_finite"))
    enough = F.col("n_finite") * 2 >= replicates
    return q.select(*by, F.when(enough, F.col("q")[0]).alias("lo"), F.when(enough, F.col("q")[1]).alias("hi"), "n_finite")


def against_controls(totals: DataFrame, gene: str, controls: list[str], replicates: int = 200) -> DataFrame:
    """(gene, lo, hi, p): omega of each other gene over that of the pooled controls, replicate by replicate.

    p is twice the smaller share of ratios on one side of 1, and never below one over the replicates.
    """
    reps = totals.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = replicate_weight(F.col("rep"), F.col("col"))
    drawn = reps.withColumn("w", w).filter("w > 0").select(gene, "rep", *((F.col(c) * F.col("w")).alias(c) for c in SUMS))
    control = F.col(gene).isin(controls)
    own = estimate(drawn.filter(~control), [gene, "rep"], saturated=1.0).select(gene, "rep", "omega")
    pooled = estimate(drawn.filter(control), ["rep"], saturated=1.0).select("rep", F.col("omega").alias("c"))
    r = own.join(F.broadcast(pooled), "rep").withColumn("ratio", F.col("omega") / F.col("c")).filter("ratio is not null")
    q = F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975)))
    side = lambda x: F.avg(x.cast("int"))
    p = 2 * F.least(side(F.col("ratio") <= 1), side(F.col("ratio") >= 1))
    out = r.groupBy(gene).agg(q.alias("q"), F.least(F.lit(1.0), F.greatest(1 / F.count("*"), p)).alias("p"))
    return out.select(gene, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p")


def replication(estimates: DataFrame, species: str, controls: list[str], least: int = 2) -> DataFrame:
    """(species, first, value) for a rank test: omegas of control genes (first) and of others, where both are ``least`` or more."""
    known = estimates.filter("omega is not null").select(species, F.col("gene").isin(controls).alias("first"), F.col("omega").alias("value"))
    n = known.groupBy(species).agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"))
    return known.join(n.filter((F.col("n1") >= least) & (F.col("n2") >= least)).select(species), species, "left_semi")
