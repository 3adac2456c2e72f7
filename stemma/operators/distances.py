"""Consensus rows of taxa, pairwise distances, trees, splits and bootstrap support.

The taxa of a group are few by nature (here the sources within a language), the
columns many.  Columns are spread over the cluster; each task adds up the small
matrices of its columns, and only matrices meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from .blocks import BLOCK, per_block, repeated
from .conservation import GAP


def consensus(rows: DataFrame, group: str, taxon: str) -> DataFrame:
    """(grp, taxon, col, ch): the most frequent letter of a taxon's rows, ties by letter, where any row has one."""

    def most(of: tuple, at: int, found: dict) -> pa.RecordBatch | None:
        letters, n, _ = found[()].arrays()
        solid = [i for i, c in enumerate(letters) if c != GAP]
        if not solid:
            return None
        n = n[solid]
        col = np.flatnonzero(n.sum(axis=0))
        best = np.array([letters[i] for i in solid], object)[n[:, col].argmax(axis=0)]  # the least letter of equal ones
        return pa.RecordBatch.from_arrays([*repeated(of, len(col)), pa.array(at * BLOCK + col + 1), pa.array(best, pa.string())], names=["grp", "taxon", "col", "ch"])

    given = rows.select(F.col(group).alias("grp"), F.col(taxon).alias("taxon"), "row")
    kinds = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in ("grp", "taxon"))
    return per_block(given, ["grp", "taxon"], [], most, f"{kinds}, col int, ch string", size=BLOCK)


def consensus_rows(cons: DataFrame) -> DataFrame:
    """(grp, taxon, row): each taxon's letters in one row, a gap where it has none; as long as its last column."""
    cells = F.map_from_entries(F.collect_list(F.struct("col", "ch")))
    of = cons.groupBy("grp", "taxon").agg(cells.alias("m"), F.max("col").alias("n"))
    row = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(GAP))), "")
    return of.select("grp", "taxon", row.alias("row"))


def pair_counts(cons: DataFrame) -> DataFrame:
    """(grp, a, b, valid, ts, tv) for every pair of taxa, by a join on the column.

    A column has one row for each taxon of its group, so that its pairs are
    bounded by the taxa; sums are formed before anything is shuffled by pair.
    """
    packed = cons.groupBy("grp", "col").agg(F.array_sort(F.collect_list(F.struct("taxon", "ch"))).alias("row"))

    def run(batches):
        sums: dict[tuple[str, str, str], np.ndarray] = {}
        kinds = {"A": 0, "G": 0, "C": 1, "T": 1}
        for b in batches:
            for grp, row in zip(b.column("grp").to_pylist(), b.column("row").to_pylist(), strict=True):
                row = [(x["taxon"], x["ch"]) for x in row if x["ch"] in kinds]
                for i, (t, x) in enumerate(row):
                    for u, y in row[i + 1 :]:
                        s = sums.setdefault((grp, t, u), np.zeros(3, np.int64))
                        s[0] += 1
                        if x != y:
                            s[1 if kinds[x] == kinds[y] else 2] += 1
        if sums:
            keys, vals = zip(*sums.items(), strict=True)
            cols = [pa.array([k[i] for k in keys]) for i in range(3)] + [pa.array([int(v[i]) for v in vals]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "a", "b", "valid", "ts", "tv"])

    partial = packed.mapInArrow(run, "grp string, a string, b string, valid bigint, ts bigint, tv bigint")
    return partial.groupBy("grp", "a", "b").agg(*(F.sum(c).alias(c) for c in ("valid", "ts", "tv")))


def distances(counts: DataFrame) -> DataFrame:
    """``counts`` with the share of differences and its Jukes-Cantor and Kimura distances; 3 without a shared column."""
    p, q = F.col("ts") / F.col("valid"), F.col("tv") / F.col("valid")
    some = F.col("valid") > 0
    return counts.select(
        "grp",
        "a",
        "b",
        "valid",
        F.when(some, p + q).alias("p"),
        F.when(some, sequence.jukes_cantor(p + q)).otherwise(3.0).alias("jc"),
        F.when(some, sequence.kimura(p, q)).otherwise(3.0).alias("k2p"),
    )


def column_weight(replicate: int, col: int) -> int:
    """How often a column is drawn in a replicate: Poisson with mean 1, from a hash, 0 replicate meaning once each.

    Drawing each column by itself needs no knowledge of the others, unlike drawing a fixed number of them.
    """
    if replicate == 0:
        return 1
    u = int.from_bytes(hashlib.blake2b(f"{replicate}:{col}".encode(), digest_size=8).digest(), "big") / 2**64
    k, p, total = 0, np.exp(-1.0), np.exp(-1.0)
    while u > total and k < 20:
        k += 1
        p /= k
        total += p
    return k


def replicate_distances(cons: DataFrame, replicates: int = 100) -> DataFrame:
    """(grp, rep, taxa, d): Jukes-Cantor matrices of the alignment (rep 0) and of its bootstrap replicates.

    A task turns its columns into pair matrices, weights them by replicate as a
    matrix product, and hands on one sum for each group.
    """
    taxa = cons.groupBy("grp").agg(F.array_sort(F.collect_set("taxon")).alias("taxa"))
    packed = cons.groupBy("grp", "col").agg(F.array_sort(F.collect_list(F.struct("taxon", "ch"))).alias("row")).join(taxa, "grp")

    def run(batches):
        sums: dict[tuple[str, tuple[str, ...]], np.ndarray] = {}
        code = {"A": 0, "C": 1, "G": 2, "T": 3}
        for b in batches:
            table = b.to_pylist()
            for at in range(0, len(table), 512):
                parts: dict[tuple[str, tuple[str, ...]], list[tuple[int, list]]] = {}
                for r in table[at : at + 512]:
                    parts.setdefault((r["grp"], tuple(r["taxa"])), []).append((r["col"], r["row"]))
                for key, cols in parts.items():
                    place = {t: i for i, t in enumerate(key[1])}
                    letters = np.full((len(cols), len(place)), 9)
                    for i, (_, row) in enumerate(cols):
                        for x in row:
                            letters[i, place[x["taxon"]]] = code.get(x["ch"], 9)
                    valid = (letters[:, :, None] < 4) & (letters[:, None, :] < 4)
                    differ = valid & (letters[:, :, None] != letters[:, None, :])
                    w = np.array([[column_weight(r, c) for c, _ in cols] for r in range(replicates + 1)], float)
                    n = len(place) ** 2
                    both = np.concatenate([valid.reshape(-1, n), differ.reshape(-1, n)], 1).astype(float)
                    sums[key] = sums.get(key, 0) + w @ both
        for (grp, names), m in sums.items():
            for rep, row in enumerate(m):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp]), pa.array([rep], pa.int32()), pa.array([list(names)]), pa.array([row.tolist()])], names=["grp", "rep", "taxa", "sums"]
                )

    partial = packed.mapInArrow(run, "grp string, rep int, taxa array<string>, sums array<double>")
    added = (
        partial.select("grp", "rep", "taxa", F.posexplode("sums").alias("i", "x"))
        .groupBy("grp", "rep", "taxa", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("grp", "rep", "taxa")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    )
    n = F.size("taxa") * F.size("taxa")
    valid, differ = F.slice("s", F.lit(1), n), F.slice("s", n + 1, n)
    d = F.transform(F.arrays_zip(valid.alias("v"), differ.alias("x")), lambda z: F.when(z["v"] > 0, sequence.jukes_cantor(z["x"] / z["v"])).otherwise(3.0))
    return added.select("grp", "rep", "taxa", d.alias("d"))


def joined_tree(d: np.ndarray, method: str = "nj") -> list[tuple[list[int], float]]:
    """Clades (taxa numbers, branch length) of the tree that neighbour joining or UPGMA builds; ties by number.

    A branch is never shorter than 0; UPGMA averages over the taxa of a cluster.
    """
    clusters = {i: [i] for i in range(len(d))}
    dist = {(i, j): float(d[i, j]) for i in range(len(d)) for j in range(i + 1, len(d))}
    height = dict.fromkeys(clusters, 0.0)
    at = lambda i, j: dist[min(i, j), max(i, j)]
    clades, new = [], len(d)
    while len(clusters) > (3 if method == "nj" else 1):
        names = sorted(clusters)
        n = len(names)
        total = {i: sum(at(i, j) for j in names if j != i) for i in names}
        cost = (lambda i, j: (n - 2) * at(i, j) - total[i] - total[j]) if method == "nj" else at
        _, i, j = min((cost(i, j), i, j) for k, i in enumerate(names) for j in names[k + 1 :])
        if method == "nj":
            first = at(i, j) / 2 + (total[i] - total[j]) / (2 * (n - 2))
            lengths = max(0.0, first), max(0.0, at(i, j) - first)
        else:
            height[new] = at(i, j) / 2
            lengths = height[new] - height[i], height[new] - height[j]
        clades += [(clusters[i], lengths[0]), (clusters[j], lengths[1])]
        for k in names:
            if k not in (i, j):
                if method == "nj":
                    to = (at(i, k) + at(j, k) - at(i, j)) / 2
                else:
                    a, b = len(clusters[i]), len(clusters[j])
                    to = (a * at(i, k) + b * at(j, k)) / (a + b)
                dist[min(k, new), max(k, new)] = to
        clusters[new] = sorted(clusters.pop(i) + clusters.pop(j))
        new += 1
    clades += [(c, 0.0) for c in clusters.values() if len(c) < len(d)] if method == "nj" else []
    return clades


def canonical(side: int, taxa: int) -> int:
    """The side of a split, as bits, that lacks taxon 0."""
    return side ^ ((1 << taxa) - 1) if side & 1 else side


def splits_of(d: np.ndarray, method: str) -> set[int]:
    """The tree's splits as bits, without those that part a single taxon from the rest."""
    n = len(d)
    sides = (canonical(sum(1 << i for i in clade), n) for clade, _ in joined_tree(d, method))
    return {s for s in sides if 1 < s.bit_count() < n - 1}


def splits_of_newick(text: str) -> set[int]:
    """The inner splits of a Newick tree, as bits of its sorted tip names."""
    from ..sources import newick as source

    rows = source.nodes(text)
    parents = {r[1] for r in rows}
    bit = {name: 1 << i for i, name in enumerate(sorted(r[2] for r in rows if r[0] not in parents))}
    below = {r[0]: 0 if r[0] in parents else bit[r[2]] for r in rows}
    for node, parent, *_ in reversed(rows):  # children stand behind their parents
        if parent is not None:
            below[parent] |= below[node]
    n = len(bit)
    sides = {canonical(side, n) for side in below.values()}
    return {s for s in sides if 1 < s.bit_count() < n - 1}


def tree_splits(matrices: DataFrame, methods: tuple[str, ...] = ("nj", "upgma")) -> DataFrame:
    """(grp, rep, method, taxa, split): a row for each inner split of each matrix's trees; taxa number 63 at most."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = len(r["taxa"])
                if n > 63:
                    raise ValueError("a split of more than 63 taxa doesn't fit into a number")
                d = np.array(r["d"], float).reshape(n, n)
                out += [(r["grp"], r["rep"], m, r["taxa"], s) for m in methods for s in sorted(splits_of(d, m))]
            if out:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["grp", "rep", "method", "taxa", "split"])

    return matrices.repartition("grp", "rep").mapInArrow(run, "grp string, rep int, method string, taxa array<string>, split bigint")


def support(splits: DataFrame, replicates: int) -> DataFrame:
    """(grp, method, split, support): the percentage of the replicates with each split of the tree itself."""
    own = splits.filter("rep = 0").select("grp", "method", "split")
    hits = splits.filter("rep > 0").groupBy("grp", "method", "split").agg(F.count("*").alias("hits"))
    return own.join(hits, ["grp", "method", "split"], "left").select("grp", "method", "split", (100 * F.coalesce("hits", F.lit(0)) / F.lit(replicates)).alias("support"))


def robinson_foulds(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """(by, rf, nrf): splits that one side has alone, and their share of both sides' numbers (0 if there are none)."""
    a, b = one.select(*by, "split").distinct().withColumn("x", F.lit(1)), other.select(*by, "split").distinct().withColumn("y", F.lit(1))
    both = a.join(b, [*by, "split"], "full").groupBy(*by)
    out = both.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("rf"), (F.count("x") + F.count("y")).alias("n"))
    return out.select(*by, "rf", F.when(F.col("n") > 0, F.col("rf") / F.col("n")).otherwise(0.0).alias("nrf"))


def discordance(own: DataFrame, reference: DataFrame, taxa: int, least: float = 70.0) -> tuple[DataFrame, DataFrame]:
    """How trees (grp, split, support) differ from one reference tree (split, support): a row a tree, and a row a conflict.

    A split of at least ``least`` support conflicts where some reference split can't
    stand in one tree with it; it is strong where such a one has that support too.
    Splits of a tree are fewer than its taxa, so their pairs are bounded.
    """
    ref = F.broadcast(reference.select(F.col("split").alias("r"), F.col("support").alias("r_support")))
    pairs = own.join(ref, ~compatible(F.col("split"), F.col("r"), taxa)).filter(F.col("support") >= least)
    conflicts = pairs.groupBy("grp", "split", "support").agg(F.count("*").alias("n_against"), F.max("r_support").alias("strongest"))
    conflicts = conflicts.withColumn("strong", F.col("strongest") >= least)
    n = F.bit_count("split")
    side = F.when(2 * n > taxa, F.col("split").bitwiseXOR(F.lit((1 << taxa) - 1))).otherwise(F.col("split"))
    conflicts = conflicts.withColumn("smaller_side", side)
    shared = own.join(reference.select("split").distinct().withColumn("same", F.lit(1)), "split", "left")
    total = reference.select("split").distinct().agg(F.count("*").alias("n_reference"))
    rows = shared.groupBy("grp").agg(F.count("*").alias("n_splits"), F.count("same").alias("n_shared"), F.avg("support").alias("mean_support"))
    per = conflicts.groupBy("grp").agg(F.count("*").alias("n_conflicts"), F.count_if("strong").alias("n_strong"))
    rows = rows.join(F.broadcast(total)).join(per, "grp", "left").fillna(0, ["n_conflicts", "n_strong"])
    rf = F.col("n_splits") + F.col("n_reference") - 2 * F.col("n_shared")
    return rows.withColumn("rf", rf).withColumn("nrf", F.when(F.col("n_splits") + F.col("n_reference") > 0, rf / (F.col("n_splits") + F.col("n_reference"))).otherwise(0.0)), conflicts


def monophyletic(splits: DataFrame, clade: int, taxa: int, by: list[str]) -> DataFrame:
    """(by, monophyletic): whether each tree has the clade in ``clade``'s bits; one of fewer than two taxa on a side always is."""
    if min(clade.bit_count(), taxa - clade.bit_count()) < 2:
        return splits.select(*by).distinct().withColumn("monophyletic", F.lit(True))
    return splits.groupBy(*by).agg(F.bool_or(F.col("split") == canonical(clade, taxa)).alias("monophyletic"))


def midpoint_rooted(text: str) -> str:
    """A Newick tree with its root halfway between its two farthest tips; inner names move with the branch that they label.

    Names and lengths stay; the old root goes where it joins two branches alone.
    """
    from ..sources import newick as source

    rows = source.nodes(text)
    near: dict[int, dict[int, float]] = {r[0]: {} for r in rows}
    label: dict[frozenset, str] = {}
    names = {r[0]: r[2] for r in rows}
    tips = [r[0] for r in rows if r[0] not in {x[1] for x in rows}]
    for node, parent, _, support, length in rows:
        if parent is not None:
            near[node][parent] = near[parent][node] = length or 0.0
            label[frozenset((node, parent))] = "" if support is None else f"{support:.2f}"

    def paths(start: int) -> dict[int, tuple[float, int | None]]:
        seen, todo = {start: (0.0, None)}, [start]
        while todo:
            x = todo.pop()
            for y, d in near[x].items():
                if y not in seen:
                    seen[y] = seen[x][0] + d, x
                    todo.append(y)
        return seen

    start = max(tips, key=lambda t, d=paths(tips[0]): (d[t][0], -t))
    far = paths(start)
    end = max(tips, key=lambda t: (far[t][0], -t))
    half, now = far[end][0] / 2, end
    while far[now][1] is not None and far[far[now][1]][0] > half:
        now = far[now][1]
    up = far[now][1]
    if up is None:
        return text

    def written(node: int, parent: int, length: float) -> str:
        below = [written(y, node, d) for y, d in near[node].items() if y != parent]
        if len(below) == 1:  # the old root between two branches
            inner, _, more = below[0].rpartition(":")
            return f"{inner}:{float(more) + length:.5f}"
        head = f"({','.join(below)}){label.get(frozenset((node, parent)), '')}" if below else names[node]
        return f"{head}:{length:.5f}"

    return f"({written(now, up, far[now][0] - half)},{written(up, now, half - far[up][0])});"


def restricted(splits: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """Splits among the taxa in the bits of ``keep``: both sides two taxa or more, canonical for the least kept one."""
    low = keep & -keep
    side = F.col("split").bitwiseAND(F.lit(keep))
    side = F.when(side.bitwiseAND(F.lit(low)) != 0, side.bitwiseXOR(F.lit(keep))).otherwise(side)
    n = F.bit_count(side)
    out = splits.withColumn("split", side).filter((n >= 2) & (F.lit(keep.bit_count()) - n >= 2))
    return out.groupBy(*by, "split").agg(F.max("support").alias("support")) if "support" in splits.columns else out.select(*by, "split").distinct()


def compatible(a, b, taxa: int):
    """Whether two splits fit one tree: one of the four intersections of their sides is empty."""
    whole = F.lit((1 << taxa) - 1)
    x, y = a.bitwiseXOR(whole), b.bitwiseXOR(whole)
    return (a.bitwiseAND(b) == 0) | (a.bitwiseAND(y) == 0) | (x.bitwiseAND(b) == 0) | (x.bitwiseAND(y) == 0)


def newick(taxa: list[str], d: np.ndarray, method: str = "nj", support: dict[int, float] | None = None) -> str:
    """The tree as text; ``support``, by canonical splits, stands behind the inner nodes, with two decimals."""
    clades = sorted({tuple(c): length for c, length in joined_tree(d, method)}.items(), key=lambda x: len(x[0]))
    text = {(i,): taxa[i] for i in range(len(taxa))}
    for clade, length in clades:
        inner = [c for c in text if set(c) <= set(clade)]
        if len(inner) > 1:
            known = (support or {}).get(canonical(sum(1 << i for i in clade), len(taxa)))
            text[clade] = "(" + ",".join(text.pop(c) for c in sorted(inner)) + ")" + ("" if known is None else f"{known:.2f}")
        text[clade] += f":{length:.5f}"
    return "(" + ",".join(text[c] for c in sorted(text)) + ");"


def tree_texts(matrices: DataFrame, supports: DataFrame | None = None, method: str = "nj") -> DataFrame:
    """(grp, value): the tree of each group's matrix of replicate 0 as text, with ``supports`` (grp, method, split, support), whole percents."""
    own = matrices.filter("rep = 0").select("grp", "taxa", "d")
    if supports is None:
        own = own.withColumn("known", F.lit(None).cast("array<struct<split:bigint,support:double>>"))
    else:
        rounded = F.struct("split", F.bround("support").alias("support"))
        own = own.join(supports.filter(F.col("method") == method).groupBy("grp").agg(F.collect_list(rounded).alias("known")), "grp", "left")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            made = [newick(r["taxa"], np.array(r["d"], float).reshape(len(r["taxa"]), -1), method, {x["split"]: x["support"] for x in r["known"] or ()}) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(made, pa.string())], names=["grp", "value"])

    return own.mapInArrow(run, "grp string, value string")


def pandas_matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """A symmetric matrix from rows (a, b, d)."""
    taxa = sorted({*rows["a"], *rows["b"]})
    at = {t: i for i, t in enumerate(taxa)}
    m = np.zeros((len(taxa), len(taxa)))
    for r in rows.itertuples():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.d
    return taxa, m
