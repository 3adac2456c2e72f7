"""Ordered and relational work on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, value, start, n): stretches of equal consecutive values, by the difference of two row numbers."""
    whole = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(by, value).orderBy(*order))
    marked = rows.withColumn("__at", whole).withColumn("__island", whole - own)
    return marked.groupBy(by, value, "__island").agg(F.min("__at").alias("start"), F.count("*").alias("n")).drop("__island")


def first_of(rows: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """The first row of each ``by``; Spark keeps one a group before it shuffles."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("__n = 1").drop("__n")


def shares(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, share) of each distinct value."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def standardised(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``rows`` with the z-score of ``value`` within ``by``; the moments are aggregated and joined, not windowed."""
    m = rows.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(m, by).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif("__s", F.lit(0.0))).drop("__m", "__s")


def significant(tests: DataFrame, q: str = "q", alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("significant", F.coalesce(F.col(q) < alpha, F.lit(False)))


def exactly_one(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``keys`` joined with ``rows``; the job fails where a key is not found, or more than once."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    found = keys.join(n, key, "left")
    same = F.coalesce("__n", F.lit(0)) == 1
    checked = found.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("not exactly one row: "), F.col(key).cast("string")))))
    return checked.drop("__n").join(rows, key)


def gaps(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """``rows`` with ``gap``: what lies between a segment and the one before it of its ``by``; null for the first."""
    along = Window.partitionBy(by).orderBy(start, end)
    return rows.withColumn("gap", F.col(start) - F.lag(end).over(along))


def running_places(cells: DataFrame, by: list[str], order: str, one: str, other: str, gap: str = "-") -> DataFrame:
    """``cells`` with ``i`` and ``j``: how many letters of either row stand up to a column; null where it is a gap."""
    along = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda c: F.when(F.col(c) != gap, F.sum((F.col(c) != gap).cast("int")).over(along))
    return cells.withColumn("i", place(one)).withColumn("j", place(other))


def concatenated(parts: DataFrame, taxon: str, gene: str, row: str, gap: str = "-") -> DataFrame:
    """(taxon, row, n_genes): each taxon's rows of all genes in a gene's order, gaps as long as a gene's rows where it has none.

    Taxa by genes is the result's own size; genes are few and go along in one array.
    """
    lengths = parts.groupBy(gene).agg(F.max(F.length(row)).alias("n"))
    genes = lengths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(gene, "n")))).alias("__genes"))
    own = parts.groupBy(taxon).agg(F.map_from_entries(F.collect_list(F.struct(gene, row))).alias("__own"), F.count("*").alias("n_genes"))
    every = F.map_keys("__genes")
    text = F.array_join(F.transform(every, lambda g: F.rpad(F.coalesce(F.col("__own")[g], F.lit("")), F.col("__genes")[g], gap)), "")
    return own.join(F.broadcast(genes)).select(taxon, text.alias("row"), "n_genes")
