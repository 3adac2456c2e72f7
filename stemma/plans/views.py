"""Views of the tables by gene, metric and limit: one prepared text each, whose arguments a caller binds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalogue import _METRICS, SEQS, query, sequence_metrics
from .panel import selection_within_species

#: Texts by name.  ``:gene`` is a gene or null for all; ``:metric`` a column's name; ``:alpha`` a limit, strict.
TEXTS = {
    "metric": """select gene, species, count(*) as n_sequences, round(median(identifier(:metric)), 7) as median,
      round(min(identifier(:metric)), 6) as least, round(max(identifier(:metric)), 6) as greatest,
      count_if(identifier(:metric) < :alpha) as n_below
    from stemma_sequence_metrics where :gene is null or gene = :gene group by gene, species""",
    "selection": """select gene, species, n_sequences, if(control, 'control', 'other') as class, concat(gene, ' (', species, ')') as name, omega,
      coalesce(omega < :alpha, false) as constrained
    from stemma_selection where :gene is null or gene = :gene""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """The views that the texts read, over one folder's tables."""
    sequence_metrics(spark, sf_dir).createOrReplaceTempView("stemma_sequence_metrics")
    selection_within_species(spark, sf_dir).createOrReplaceTempView("stemma_selection")


def ask(spark: SparkSession, name: str, *, gene: str | None = None, alpha: float = 0.05, metric: str | None = None) -> DataFrame:
    """The text ``name`` with its arguments bound: Spark plans it with them as literals, so that filters reach the scan."""
    given = {"gene": gene, "alpha": alpha} | ({"metric": metric} if metric else {})
    return spark.sql(TEXTS[name], args=given)


VIEWED = ("gc", "gc3", "gc_skew")


@query(
    f"with {SEQS}, m as ({_METRICS}) "
    + " union all ".join(
        f"""select '{c}' as metric, gene, species, count(*) as n_sequences, round(median({c}), 7) as median, round(min({c}), 6) as least, round(max({c}), 6) as greatest,
        count(*) filter ({c} < 0.45) as n_below from m group by gene, species"""
        for c in VIEWED
    )
)
def metric_views(spark, sf_dir):
    """Every gene and metric through one prepared text."""
    from pyspark.sql import functions as F

    register(spark, sf_dir)
    found = None
    for c in VIEWED:
        one = ask(spark, "metric", metric=c, alpha=0.45).withColumn("metric", F.lit(c))
        found = one if found is None else found.unionByName(one)
    return found


def _selection_sql() -> str:
    from .catalogue import SQL

    return f"""select gene, species, n_sequences, case when control then 'control' else 'other' end as class, gene || ' (' || species || ')' as name, omega,
      coalesce(omega < 0.4, false) as constrained from ({SQL["selection_within_species"]})"""


@query(_selection_sql())
def selection_view(spark, sf_dir):
    """Names, classes and a limit beside each gene's omega, through one prepared text."""
    register(spark, sf_dir)
    return ask(spark, "selection", alpha=0.4)
