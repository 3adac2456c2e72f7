"""Many trees as node rows (tree, node, parent, name, support, length): path sums, farthest tips and midpoint roots by joins.

Ancestors are reached by doubling: step j of a ladder leads from a node to its
2^j-th ancestor, so that all sums along paths take as many joins as the logarithm
of the depth, for all trees at once and however large one is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

NODES = ["tree", "node", "parent", "name", "support", "length"]


def ladder(nodes: DataFrame) -> list[DataFrame]:
    """(tree, node, up, sum, hops) for the 1st, 2nd, 4th, ... ancestor, where there is one; sums of branch lengths."""
    own = nodes.filter("parent is not null")
    now = written(own.select("tree", "node", F.col("parent").alias("up"), F.coalesce("length", F.lit(0.0)).alias("sum"), F.lit(1).alias("hops")))
    steps = []
    while not now.isEmpty():
        steps.append(now)
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("sum").alias("more"), F.col("hops").alias("plus"))
        now = written(now.join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("hops") + F.col("plus")).alias("hops")))
    return steps


def heights(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(tree, node, height, depth): the length of the path to the root, and its number of branches."""
    at = nodes.select("tree", "node", F.col("node").alias("at"), F.lit(0.0).alias("height"), F.lit(0).alias("depth"))
    for step in reversed(steps):
        s = step.select("tree", F.col("node").alias("at"), "up", "sum", "hops")
        moved = F.coalesce("up", "at").alias("at"), (F.col("height") + F.coalesce("sum", F.lit(0.0))).alias("height"), (F.col("depth") + F.coalesce("hops", F.lit(0))).alias("depth")
        at = at.join(s, ["tree", "at"], "left").select("tree", "node", *moved)
    return at.drop("at")


def ancestors(starts: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(tree, node): the nodes of ``starts`` (tree, node) and all their ancestors."""
    found = starts.select("tree", "node")
    for step in steps:
        found = found.union(found.join(step, ["tree", "node"]).select("tree", F.col("up").alias("node"))).distinct()
    return found


def distances_from(nodes: DataFrame, known: DataFrame, steps: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(tree, node, distance, hops) of every node from its tree's node in ``starts`` (tree, node); ``known`` are the heights."""
    marked = written(ancestors(starts, steps))
    at = nodes.select("tree", "node", F.col("node").alias("at"))
    for step in reversed(steps):  # as far up as no ancestor of the start is met
        free = step.join(marked.withColumnRenamed("node", "up"), ["tree", "up"], "left_anti").select("tree", F.col("node").alias("at"), "up")
        at = at.join(free, ["tree", "at"], "left").select("tree", "node", F.coalesce("up", "at").alias("at"))
    of = nodes.select("tree", F.col("node").alias("at"), "parent").join(marked.select("tree", F.col("node").alias("at"), F.lit(True).alias("met")), ["tree", "at"], "left")
    meets = at.join(of, ["tree", "at"]).select("tree", "node", F.when(F.col("met"), F.col("at")).otherwise(F.col("parent")).alias("meet"))
    meet = known.select("tree", F.col("node").alias("meet"), F.col("height").alias("mh"), F.col("depth").alias("md"))
    start = starts.join(known, ["tree", "node"]).select("tree", F.col("height").alias("sh"), F.col("depth").alias("sd"))
    whole = meets.join(known, ["tree", "node"]).join(meet, ["tree", "meet"]).join(start, "tree")
    return whole.select("tree", "node", (F.col("height") + F.col("sh") - 2 * F.col("mh")).alias("distance"), (F.col("depth") + F.col("sd") - 2 * F.col("md")).alias("hops"))


def _first(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).filter("__n = 1").drop("__n")


def midpoint_rooted(nodes: DataFrame) -> DataFrame:
    """Node rows of the trees with their roots halfway between their two farthest tips, ties to the least nodes.

    The root is a new node.  Branches from the old root to the new one turn round and
    take their supports along; an old root that then joins two branches alone goes.
    A tree of one node stays as it is.
    """
    nodes = written(nodes.select(*NODES))
    steps = ladder(nodes)
    known = written(heights(nodes, steps))
    tips = nodes.join(nodes.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct(), ["tree", "node"], "left_anti").select("tree", "node")
    away = lambda starts: written(distances_from(nodes, known, steps, starts))
    farthest = lambda d: written(_first(d.join(tips, ["tree", "node"], "left_semi"), F.desc("distance"), "node"))
    start = farthest(away(tips.groupBy("tree").agg(F.min("node").alias("node"))))
    one = away(start)
    end = farthest(one)
    other = away(end).select("tree", "node", F.col("hops").alias("back"))
    whole = end.select("tree", (F.col("distance") / 2).alias("half"), F.col("hops").alias("total"), F.col("node").alias("last"))
    path = one.join(other, ["tree", "node"]).join(whole, "tree").filter("hops + back = total and total > 0")
    beyond = _first(path.filter((F.col("distance") > F.col("half")) | (F.col("node") == F.col("last"))), "hops")
    near = path.select("tree", F.col("node").alias("up"), F.col("hops").alias("h"), F.col("distance").alias("far"))
    cut = written(beyond.join(near, "tree").filter("h = hops - 1").select("tree", F.col("node").alias("now"), "up", (F.col("distance") - F.col("half")).alias("below"), (F.col("half") - F.col("far")).alias("above")))

    # The lower end of the branch that is cut, its upper end and what is above: these turn round.
    ends = cut.select("tree", F.explode(F.array("now", "up")).alias("node"), "now", "up")
    low = ends.join(nodes, ["tree", "node"]).filter((F.col("parent") == F.col("now")) | (F.col("parent") == F.col("up"))).select("tree", "node", "parent", F.col("support").alias("label"))
    chain = written(ancestors(low.select("tree", F.col("parent").alias("node")), steps))
    turned = nodes.join(chain, ["tree", "node"], "left_semi").filter("parent is not null").select("tree", F.col("parent").alias("node"), F.col("node").alias("parent"), "support", "length")
    root = nodes.groupBy("tree").agg((F.max("node") + 1).alias("root"))
    halves = cut.join(root, "tree").select("tree", "root", F.explode(F.array(F.struct(F.col("now").alias("node"), F.col("below").alias("length")), F.struct(F.col("up").alias("node"), F.col("above").alias("length")))).alias("x"))
    halves = halves.join(low.select("tree", "label"), "tree").select("tree", "x.node", F.col("root").alias("parent"), F.col("label").alias("support"), "x.length")
    moved = turned.join(halves, ["tree", "node"], "left_anti").unionByName(halves)
    names = nodes.select("tree", "node", "name")
    still = nodes.join(moved, ["tree", "node"], "left_anti")
    fresh = cut.join(root, "tree").select("tree", F.col("root").alias("node"), F.lit(None).cast("int").alias("parent"), F.lit("").alias("name"), F.lit(None).cast("double").alias("support"), F.lit(None).cast("double").alias("length"))
    new = written(moved.join(names, ["tree", "node"]).select(*NODES).unionByName(still.select(*NODES)).unionByName(fresh))

    # An inner node with one branch below it was the root.
    inner = new.groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    lone = new.join(inner.filter("n = 1"), ["tree", "node"], "left_semi").join(cut.select("tree"), "tree", "left_semi").filter("parent is not null")
    gone = lone.select("tree", F.col("node").alias("parent"), F.col("parent").alias("over"), F.col("length").alias("more"))
    joined = new.join(gone, ["tree", "parent"], "left").join(lone.select("tree", "node"), ["tree", "node"], "left_anti")
    # A support is an inner node's; ends of branches that now are tips have none.
    length = F.when(F.col("over").isNotNull(), F.coalesce("length", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).otherwise(F.col("length"))
    below = joined.select("tree", F.coalesce("over", "parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    return joined.join(below, ["tree", "node"], "left").select("tree", "node", F.coalesce("over", "parent").alias("parent"), "name", F.when(F.col("inner"), F.col("support")).alias("support"), length.alias("length"))


def texts(nodes: DataFrame) -> DataFrame:
    """(tree, value): each tree in Newick's form, supports with two decimals before the lengths, children in the order of their numbers."""

    def one(group: pa.Table) -> pa.Table:
        rows = {r["node"]: r for r in group.to_pylist()}
        below: dict[int | None, list[int]] = {}
        for node in sorted(rows):
            below.setdefault(rows[node]["parent"], []).append(node)
        out, todo = [], [(x, 0) for x in reversed(below[None])]
        while todo:
            node, k = todo.pop()
            children, r = below.get(node, []), rows[node]
            if k < len(children):
                out.append("," if k else "(")
                todo += [(node, k + 1), (children[k], 0)]
                continue
            label = r["name"] or ("" if r["support"] is None else f"{r['support']:.2f}")
            quoted = "'" + label.replace("'", "''") + "'" if any(c in " ()[]:;,'" for c in label) else label
            out.append((")" if children else "") + quoted + ("" if r["length"] is None else f":{r['length']:.5f}"))
        return pa.table({"tree": group.column("tree").slice(0, 1), "value": ["".join(out) + ";"]})

    return nodes.groupBy("tree").applyInArrow(one, f"tree {nodes.schema['tree'].dataType.simpleString()}, value string")
