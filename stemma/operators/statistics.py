"""Two-group rank statistics, bootstrap intervals and false-discovery control.

Equal values are counted before they are ordered, and distinct ones are ordered by
range partitions with offsets (``order.below``): ranks are of the exact values, and
no task sees a whole group.  ``places`` rounds values whose last digits depend on
the order of a sum.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import below, exact
from .selection import replicate_weight


def _ordered(values: DataFrame, by: list[str], places: int | None) -> DataFrame:
    """(by, v, n1, n2, below_n2): counts of the two groups at each distinct value, and of group 2 below it."""
    v = values.filter("value is not null").withColumn("v", exact("value", places))
    counts = v.groupBy(*by, "v").agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"))
    return below(counts, by, "v", "n2")


def rank_test(values: DataFrame, by: list[str], places: int | None = None) -> DataFrame:
    """(by, n1, n2, u, delta, ties) from rows (by, first boolean, value): Mann-Whitney's U of the first group and Cliff's delta.

    Each pair of values that ties counts one half; ``ties`` sums t^3 - t over tied values.
    """
    t = F.col("n1") + F.col("n2")
    sums = _ordered(values, by, places).groupBy(*by).agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * (F.col("below_n2") + F.col("n2") / 2)).alias("u"),
        F.sum((t * t * t - t).cast("double")).alias("ties"),
    )
    pairs = F.nullif(F.col("n1") * F.col("n2"), F.lit(0))
    return sums.select(*by, "n1", "n2", "u", (2 * F.col("u") / pairs - 1).alias("delta"), "ties")


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties, by counting the orders with each U."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for j in range(1, n1 + n2 + 1):
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n2:
                row, less = ways[i], ways[i - 1]
                for x in range(n1 * n2, shift - 1, -1):
                    row[x] += less[x - shift]
    count = ways[n1]
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(count[math.ceil(top) :]) / math.comb(n1 + n2, n1))


def p_value(u: float, n1: int, n2: int, ties: float) -> float | None:
    """Exact without ties and a group of 8 or fewer, else normal with tie and continuity corrections; null if all tie."""
    if not n1 or not n2:
        return None
    if ties == 0 and min(n1, n2) <= 8:
        return exact_p(u, n1, n2)
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return None
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def with_p(tests: DataFrame) -> DataFrame:
    """``tests`` (a row for each test) with ``p``."""

    def run(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("u", "n1", "n2", "ties"))
            yield b.append_column("p", pa.array([p_value(*x) for x in zip(*cols, strict=True)], pa.float64()))

    return tests.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema), "p double"]))


def adjusted(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """``tests`` with Benjamini and Hochberg's q-values; null p-values stay null and don't count.

    The window is over the tests, a row for each comparison, not over data.
    """
    known = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy(known).orderBy(p))
    from_right = Window.partitionBy(known).orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tests.withColumn("__rank", rank).withColumn("__x", F.col(p) * m / F.col("__rank"))
    return ranked.withColumn(q, F.when(known, F.least(F.lit(1.0), F.min("__x").over(from_right)))).drop("__rank", "__x")


def medians(values: DataFrame, by: list[str]) -> DataFrame:
    out = values.groupBy(*by).agg(
        F.median(F.when(F.col("first"), F.col("value"))).alias("median1"), F.median(F.when(~F.col("first"), F.col("value"))).alias("median2")
    )
    return out.withColumn("median_difference", F.col("median1") - F.col("median2"))


def mean_difference_interval(values: DataFrame, by: list[str], key: str, replicates: int = 200) -> DataFrame:
    """(by, difference, lo, hi): percentile bootstrap of the difference of means, by Poisson weights drawn for each row."""
    v = values.filter("value is not null").select(*by, key, "first", "value")
    reps = v.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    w = F.when(F.col("rep") == 0, 1).otherwise(replicate_weight(F.col("rep"), F.col(key)))
    mean = lambda side: F.sum(F.when(side, F.col("w") * F.col("value"))) / F.nullif(F.sum(F.when(side, F.col("w"))), F.lit(0))
    per = reps.withColumn("w", w).groupBy(*by, "rep").agg((mean(F.col("first")) - mean(~F.col("first"))).alias("d"))
    q = F.percentile(F.when(F.col("rep") > 0, F.col("d")), F.array(F.lit(0.025), F.lit(0.975)))
    out = per.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("difference"), q.alias("q"))
    return out.select(*by, "difference", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def resampled_difference(values: DataFrame, by: list[str], replicates: int = 5000, places: int = 6) -> DataFrame:
    """(by, difference, lo, hi): as ``mean_difference_interval``, from the counts of distinct rounded values.

    A value that n rows share has the sum of their weights, a Poisson draw with
    mean n.  Each task adds up its values' draws for all replicates, and only
    these sums are shuffled.  Replicate 0 is the data.
    """
    v = values.filter("value is not null").withColumn("v", F.round("value", places).cast("double"))
    counts = v.groupBy(*by, "v").agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"))
    names = ("w1", "s1", "w2", "s2")

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *group, x, n1, n2 in zip(*(b.column(c).to_pylist() for c in (*by, "v", "n1", "n2")), strict=True):
                rng = np.random.default_rng([zlib.crc32(repr(group).encode()), int(np.float64(x + 0.0).view(np.uint64))])
                w1, w2 = (np.concatenate([[n], rng.poisson(n, replicates)]) for n in (n1, n2))
                held = sums.setdefault(tuple(group), np.zeros((len(names), replicates + 1)))
                held += np.stack([w1, w1 * x, w2, w2 * x])
        for group, held in sums.items():
            of_group = [pa.array([g] * (replicates + 1)) for g in group]
            yield pa.RecordBatch.from_arrays([*of_group, pa.array(np.arange(replicates + 1)), *(pa.array(x) for x in held)], names=[*by, "rep", *names])

    kinds = [f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by]
    per_task = counts.mapInArrow(run, ", ".join([*kinds, "rep bigint", *(f"{c} double" for c in names)]))
    sums = per_task.groupBy(*by, "rep").agg(*(F.sum(c).alias(c) for c in names))
    mean = lambda i: F.col(f"s{i}") / F.nullif(F.col(f"w{i}"), F.lit(0.0))
    d = sums.withColumn("d", mean(1) - mean(2))
    q = F.percentile(F.when(F.col("rep") > 0, F.col("d")), F.array(F.lit(0.025), F.lit(0.975)))
    out = d.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("difference"), q.alias("q"))
    return out.select(*by, "difference", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def ranks(values: DataFrame, value: str, name: str, places: int | None = None) -> DataFrame:
    """``values`` with the average rank of ``value``."""
    v = values.withColumn("__v", exact(value, places))
    counts = v.groupBy("__v").agg(F.count("*").alias("__n"))
    table = below(counts, [], "__v", "__n").select("__v", (F.col("below___n") + (F.col("__n") + 1) / 2).alias(name))
    return v.join(table, "__v").drop("__v")


def spearman(values: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): the correlation of average ranks over rows that have both values."""
    both = values.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranks(ranks(both, x, "__rx"), y, "__ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias("rho"))


def midranks(values: DataFrame, by: str, value: str, places: int | None = None) -> DataFrame:
    """(by, value, midrank, n, strict, worst): the percentage of a group's rows with a greater value, for each distinct value.

    Rows with an equal value count half in ``midrank``, not at all in ``strict``, which
    is a value's best case, and whole in ``worst``.
    """
    counts = values.groupBy(by, exact(value, places).alias(value)).agg(F.count("*").alias("n"))
    known = below(counts, [by], value, "n")
    totals = counts.groupBy(by).agg(F.sum("n").alias("__total")).withColumnRenamed(by, "__by")
    greater = F.col("__total") - F.col("below_n") - F.col("n")
    found = known.join(totals, F.col(by).eqNullSafe(F.col("__by")))
    share = lambda x: 100 * x / F.col("__total")
    return found.select(by, value, share(greater + F.col("n") / 2).alias("midrank"), "n", share(greater).alias("strict"), share(greater + F.col("n")).alias("worst"))


def resampled_statistics(values: DataFrame, by: list[str], replicates: int = 5000, places: int = 6, chunks: int = 20) -> DataFrame:
    """(by, median_lo, median_hi, delta_lo, delta_hi): percentile bootstrap of the difference of medians and of Cliff's delta.

    Both come from the counts of distinct rounded values.  A resampled group's
    median is its sample's value at a beta distributed rank, and its counts are
    Poisson draws.  Replicates are dealt over ``chunks`` tasks of each test.
    """
    v = values.filter("value is not null").withColumn("v", F.round("value", places).cast("double"))
    counts = v.groupBy(*by, "v").agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"))
    dealt = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kinds = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("v")
        x, ns = g["v"].to_numpy(), [g[c].to_numpy() for c in ("n1", "n2")]
        sizes, n = [int(k.sum()) for k in ns], -(-replicates // chunks)
        out = pd.DataFrame({c: [g[c].iloc[0]] * n for c in by})
        rng = np.random.default_rng([zlib.crc32(repr(g[by].iloc[0].tolist()).encode()), int(g["chunk"].iloc[0])])
        if not all(sizes):
            return out.assign(m=np.nan, d=np.nan)
        at = [np.searchsorted(np.cumsum(k), np.ceil(size * rng.beta((size + 1) / 2, (size + 1) / 2, n))) for k, size in zip(ns, sizes, strict=True)]
        deltas = []
        for _ in range(n):
            a, b = (rng.poisson(k) for k in ns)
            u = (a * (np.cumsum(b) - b / 2)).sum()
            deltas.append(2 * u / (a.sum() * b.sum()) - 1 if a.any() and b.any() else np.nan)
        return out.assign(m=x[at[0]] - x[at[1]], d=deltas)

    drawn = dealt.groupBy(*by, "chunk").applyInPandas(run, f"{kinds}, m double, d double")
    bounds = F.array(F.lit(0.025), F.lit(0.975))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    q = drawn.groupBy(*by).agg(F.percentile(real("m"), bounds).alias("m"), F.percentile(real("d"), bounds).alias("d"))
    return q.select(*by, *(F.col(c)[i].alias(f"{name}_{side}") for c, name in (("m", "median"), ("d", "delta")) for i, side in ((0, "lo"), (1, "hi"))))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d)
        c = 1 + term / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation, by Student's distribution with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def spearman_test(values: DataFrame, x: str, y: str, key: str, replicates: int = 2000) -> DataFrame:
    """(n, rho, p, lo, hi): ``spearman`` with its p-value and a bootstrap interval.

    Each row gets a Poisson weight for each replicate, from a hash of its key; a
    task adds up its rows' weighted sums of ranks, which are those in the whole
    table, and only the sums of replicates are shuffled.
    """
    both = values.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranks(ranks(both, x, "__rx"), y, "__ry").select(F.xxhash64(key).alias("k"), F.col("__rx").cast("double").alias("a"), F.col("__ry").cast("double").alias("b"))
    names = ("w", "wa", "wb", "waa", "wbb", "wab")

    def run(batches):
        sums = np.zeros((len(names), replicates + 1))
        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "a", "b")), strict=True):
                w = np.concatenate([[1], np.random.default_rng(int(k) & (2**63 - 1)).poisson(1.0, replicates)])
                sums += np.outer([1, a, b, a * a, b * b, a * b], w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1)), *(pa.array(s) for s in sums)], names=["rep", *names])

    added = ranked.mapInArrow(run, ", ".join(["rep bigint", *(f"{c} double" for c in names)])).groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))
    spread = lambda p, q, pq: F.col(pq) * F.col("w") - F.col(p) * F.col(q)
    down = F.sqrt(spread("wa", "wa", "waa") * spread("wb", "wb", "wbb"))
    per = added.select("rep", "w", F.when(down > 0, spread("wa", "wb", "wab") / down).alias("r"))
    q = F.percentile(F.when(F.col("rep") > 0, F.col("r")), F.array(F.lit(0.025), F.lit(0.975)))
    own = lambda c: F.max(F.when(F.col("rep") == 0, F.col(c)))
    one = per.agg(own("w").cast("bigint").alias("n"), own("r").alias("rho"), q.alias("q"))

    def with_test(batches):
        for batch in batches:
            p = [correlation_p(r, n) for r, n in zip(batch.column("rho").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield batch.append_column("p", pa.array(p, pa.float64()))

    done = one.select("n", "rho", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return done.mapInArrow(with_test, "n bigint, rho double, lo double, hi double, p double")
