"""Sums over smaller values without a window over a whole group or table.

The distinct values are dealt to partitions by range; a partition's offset is the
sum of those before it, and within it a window adds up the rest.  Partitions, not
values, are what meets in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

PART = "__part"


def exact(value: str, places: int | None) -> Column:
    """The value itself, a negative zero as zero; or to ``places`` decimals, for sums whose last digits depend on their order."""
    v = F.col(value) if places is None else F.round(value, places)
    return v + F.lit(0).cast("double") if places is None else v


def below(counts: DataFrame, by: list[str], value: str, *sums: str) -> DataFrame:
    """``counts``, a row for each distinct ``value`` of a group, with ``below_<c>``: the sum of c over the group's smaller values."""
    dealt = written(counts.repartitionByRange(*by, value).withColumn(PART, F.spark_partition_id()))
    per_part = dealt.groupBy(*by, PART).agg(*(F.sum(c).alias(c) for c in sums))
    names = [f"below_{c}" for c in sums]
    if by:
        before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_part.select(*by, PART, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in zip(sums, names, strict=True)))
    else:  # as many numbers as partitions, added up by the driver
        rows, held = sorted(per_part.collect(), key=lambda r: r[PART]), [0] * len(sums)
        found = []
        for r in rows:
            found.append((r[PART], *held))
            held = [x + r[c] for x, c in zip(held, sums, strict=True)]
        kinds = ", ".join([f"{PART} int", *(f"`{n}` {per_part.schema[c].dataType.simpleString()}" for c, n in zip(sums, names, strict=True))])
        offsets = F.broadcast(counts.sparkSession.createDataFrame(found, kinds))
    keys = [*by, PART]
    other = offsets.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keys)), *names)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(keys)))
    within = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(other, same)
    added = {n: F.col(n) + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, n in zip(sums, names, strict=True)}
    return joined.withColumns(added).select(*counts.columns, *names)
