"""FASTA text, plain or gzipped, as rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, seq): records are split by the reader itself, so that large files are read in parallel.

    The id is the header up to its first white space; sequences are upper-cased.
    Repeated ids stay apart; ``last_of_each`` keeps one.
    """
    records = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    parts = F.split("value", "\r?\n", 2)
    header = F.trim(parts[0])
    seq = F.upper(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", ""))
    return records.select(F.split(header, r"\s")[0].alias("id"), header.alias("header"), seq.alias("seq"))


def last_of_each(records: DataFrame, order: str) -> DataFrame:
    """One record for each id, the last by ``order``."""
    return records.groupBy("id").agg(*(F.max_by(c, order).alias(c) for c in records.columns if c not in ("id", order)))


def record(id_: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), id_, F.lit("\n"), seq)


def headed(id_: Column, **fields: Column) -> Column:
    """An id followed by its fields as name=value; null fields are left out."""
    return F.concat_ws(" ", id_, *(F.concat(F.lit(f"{name}="), c.cast("string")) for name, c in fields.items()))


def write(records: DataFrame, path: str, *, by: str | None = None, compression: str | None = None) -> None:
    """Records as FASTA, in a folder of its own for each value of ``by``."""
    lines = records.select(*([by] if by else []), record(F.col("id"), F.col("seq")).alias("value"))
    writer = lines.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    (writer.partitionBy(by) if by else writer).text(path)
