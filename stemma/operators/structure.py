"""Geometry of points in space: distances to a centre, bins, angles, axes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import Scoring, aligned_segments


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def distance_to_centre(points: DataFrame, centre: DataFrame) -> DataFrame:
    """``points`` with their distance to the one row of ``centre``."""
    d = F.sqrt(sum((F.pow(F.col(p) - F.col(f"c{p}"), F.lit(2)) for p in "xyz"), F.lit(0.0)))
    return points.join(F.broadcast(centre)).withColumn("distance", d).drop("cx", "cy", "cz")


def near_and_far(points: DataFrame, value: str, limit: float) -> DataFrame:
    near = F.col("distance") <= limit
    return points.agg(
        F.count_if(near).alias("n_near"), F.avg(F.when(near, F.col(value))).alias("mean_near"), F.count_if(~near).alias("n_far"), F.avg(F.when(~near, F.col(value))).alias("mean_far")
    )


def binned(points: DataFrame, by: str, value: str, width: float) -> DataFrame:
    return points.groupBy(F.floor(F.col(by) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def histogram2d(points: DataFrame, x: str, y: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bx, by, n) of the cells that hold a point; the last cell of a side includes its upper bound."""
    cell = lambda c: F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    inside = F.col(x).between(lo, hi) & F.col(y).between(lo, hi)
    return points.filter(inside).groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.count("*").alias("n"))


def region(phi: Column, psi: Column) -> Column:
    """Class of a pair of backbone angles; the first that fits."""
    return (
        F.when((phi < 0) & (psi > -120) & (psi < 50), "alpha")
        .when((phi < 0) & ((psi >= 50) | (psi <= -150)), "beta")
        .when(phi >= 0, "left-handed")
        .otherwise("other")
    )


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, (x * y for x, y in zip(a, b, strict=True)))


def dihedral(p: list[list[Column]]) -> Column:
    """The torsion angle of four points, in degrees."""
    b0, b1, b2 = (_minus(p[i + 1], p[i]) for i in range(3))
    n1, n2 = _cross(b0, b1), _cross(b1, b2)
    y = _dot(_cross(n1, n2), b1) / F.sqrt(_dot(b1, b1))
    return F.degrees(F.atan2(y, _dot(n1, n2)))


def chain_dihedrals(points: DataFrame, chain: str, order: str) -> DataFrame:
    """``points`` with the torsion angle of each and its next three along a chain; null at a chain's end."""
    along = Window.partitionBy(chain).orderBy(order)
    at = lambda c, i: F.lead(c, i).over(along) if i else F.col(c)
    quads = points.select("*", *(at(c, i).alias(f"__{c}{i}") for i in range(1, 4) for c in "xyz"))
    p = [[F.col(c) for c in "xyz"], *([F.col(f"__{c}{i}") for c in "xyz"] for i in range(1, 4))]
    return quads.withColumn("dihedral", F.when(F.col("__x3").isNotNull(), dihedral(p))).select(*points.columns, "dihedral")


def linked_segments(atoms: DataFrame, chain: str, number: str, value: str, far: float = 4.3) -> DataFrame:
    """A row for each two consecutive residues of a chain: whether they are bonded, and the mean of what is known of ``value``.

    Bonded are neighbours by number whose atoms lie nearer than ``far``.
    """
    along = Window.partitionBy(chain).orderBy(number)
    before = lambda c: F.lag(c).over(along)
    d = F.sqrt(sum((F.pow(F.col(c) - before(c), F.lit(2)) for c in "xyz"), F.lit(0.0)))
    both = atoms.select(chain, number, (F.col(number) - before(number)).alias("step"), d.alias("distance"), F.col(value).alias("own"), before(value).alias("last"))
    mean = F.coalesce((F.col("own") + F.col("last")) / 2, "own", "last")
    bonded = (F.col("step") == 1) & (F.col("distance") < far)
    return both.filter("step is not null").select(chain, number, "distance", bonded.alias("bonded"), mean.alias("value"))


def residue_table(atoms: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """(chain, number, residue, x, y, z, b): standard residues with their alpha carbon, the first of its alternatives."""
    alpha = atoms.filter((F.col("atom") == "CA") & (F.col("record") == "ATOM") & F.col("residue").isin(*standard))
    names = ("residue", "x", "y", "z", "b")
    first = alpha.groupBy("chain", "number").agg(F.min_by(F.struct(*names), "serial").alias("f"))
    return first.select("chain", "number", *(f"f.{c}" for c in names))


def reference_positions(residues: DataFrame, references: DataFrame, letters: dict[str, str], scoring: Scoring = Scoring()) -> DataFrame:
    """``residues`` (chain, number, residue, ...) with ``aa``, ``ref_position`` and ``ref_aa``: where a chain's residues stand in its reference.

    ``references`` are (chain, seq).  A chain's residues in the order of their numbers
    are aligned with its reference from end to end.  The aligned segments are one map,
    from a residue's place in the chain to the reference; a residue outside of them,
    and every residue of a chain without a reference, keeps its row without a position.
    """
    code = F.create_map(*(F.lit(x) for pair in letters.items() for x in pair))
    along = Window.partitionBy("chain").orderBy("number")
    placed = residues.withColumn("aa", F.coalesce(F.try_element_at(code, F.col("residue")), F.lit("X"))).withColumn("place", F.row_number().over(along) - 1)
    chains = placed.groupBy("chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "aa"))), lambda x: x["aa"]), "").alias("q"))
    segments = aligned_segments(chains.join(references.withColumnRenamed("seq", "t"), "chain").repartition("chain"), scoring, local=False)
    each = segments.select("chain", "t_start", F.posexplode(F.sequence("q_start", F.col("q_end") - 1)).alias("i", "place"))
    known = each.select("chain", "place", (F.col("t_start") + F.col("i") + 1).alias("ref_position"))
    found = placed.join(known, ["chain", "place"], "left").join(references, "chain", "left")
    return found.withColumn("ref_aa", F.when(F.col("ref_position").isNotNull(), F.substring("seq", F.col("ref_position"), F.lit(1)))).drop("seq", "place")


def with_column_scores(residues: DataFrame, numbered: DataFrame, scores: DataFrame) -> DataFrame:
    """``residues`` of ``reference_positions`` with ``col`` and ``conservation``, null where a residue has no position or its column no score.

    ``numbered`` (gene, col, ref_position) is the other map, from the reference's
    positions to an alignment's columns; ``scores`` are (gene, col, conservation).
    """
    columns = numbered.filter("ref_position is not null").select(F.col("gene").alias("chain"), "col", F.col("ref_position").cast("int").alias("ref_position"))
    scored = columns.join(scores.select(F.col("gene").alias("chain"), "col", "conservation"), ["chain", "col"], "left")
    return residues.join(scored, ["chain", "ref_position"], "left")


def summary(points: DataFrame, value: str, near: float) -> DataFrame:
    """One row: how many points, mean and extremes of distance and value, and means near to and far from the centre."""
    close = F.col("distance") <= near
    return points.agg(
        F.count("*").alias("n"), F.count(value).alias("n_scored"), F.avg(value).alias("mean_value"), F.min("distance").alias("least_distance"),
        F.max("distance").alias("greatest_distance"), F.avg("distance").alias("mean_distance"), F.count_if(close).alias("n_near"),
        F.avg(F.when(close, F.col(value))).alias("mean_near"), F.avg(F.when(~close, F.col(value))).alias("mean_far"), F.corr("distance", value).alias("correlation"),
    )


def backbone(points: DataFrame, chain: str, order: str) -> DataFrame:
    """(chain, residue, phi, psi): points in runs of three are a residue's N, CA and C; phi looks back, psi ahead.

    Points of a last residue that isn't whole are left out.
    """
    numbered = points.withColumn("__at", F.row_number().over(Window.partitionBy(chain).orderBy(order)) - 1)
    atom = lambda i, c: F.max(F.when(F.col("__at") % 3 == i, F.col(c)))
    of = numbered.groupBy(chain, F.floor(F.col("__at") / 3).alias("residue")).agg(F.count("*").alias("__n"), *(atom(i, c).alias(f"{n}{c}") for i, n in enumerate("nac") for c in "xyz"))
    along = Window.partitionBy(chain).orderBy("residue")
    point = lambda n: [F.col(f"{n}{c}") for c in "xyz"]
    whole = of.filter("__n = 3").select("*", *(F.lag(f"c{c}").over(along).alias(f"b{c}") for c in "xyz"), *(F.lead(f"n{c}").over(along).alias(f"m{c}") for c in "xyz"))
    phi = F.when(F.col("bx").isNotNull(), dihedral([point("b"), point("n"), point("a"), point("c")]))
    psi = F.when(F.col("mx").isNotNull(), dihedral([point("n"), point("a"), point("c"), point("m")]))
    return whole.select(chain, F.col("residue").cast("bigint").alias("residue"), phi.alias("phi"), psi.alias("psi"))


def principal_axes(points: DataFrame) -> list[np.ndarray]:
    """Axes of greatest variance, from nine sums that the cluster adds up; an axis's first non-zero part is positive."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    row = points.agg(*(F.covar_pop(a, b).alias(a + b) for a, b in pairs)).first()
    m = np.array([[row[min(a, b) + max(a, b)] for b in "xyz"] for a in "xyz"], float)
    values, vectors = np.linalg.eigh(m)
    axes = [vectors[:, i] for i in np.argsort(-values)]
    return [v if v[np.flatnonzero(np.abs(v) > 1e-12)[0]] > 0 else -v for v in axes]
