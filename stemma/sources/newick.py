"""Newick trees as node rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node int, parent int, name string, support double, length double"
_TOKEN = re.compile(r"\s*([(),;]|:[^(),;:]*|'(?:[^']|'')*'|[^(),:;]+)")


def nodes(text: str) -> list[tuple[int, int | None, str, float | None, float | None]]:
    """(node, parent, name, support, length), parents first; an inner node's numeric name is its support.

    Of several lengths behind one node the last counts.
    """
    rows: list[list] = [[0, None, "", None, None]]
    stack, now = [], 0
    inner: set[int] = set()
    for m in _TOKEN.finditer(text):
        t = m[1].strip()
        if t == "(" or t == ",":
            if t == "(":
                inner.add(now)
                stack.append(now)
            rows.append([len(rows), stack[-1], "", None, None])
            now = len(rows) - 1
        elif t == ")":
            now = stack.pop()
        elif t == ";":
            break
        elif t.startswith(":"):
            rows[now][4] = float(t[1:])
        elif t:
            rows[now][2] = t.strip("'").replace("''", "'")
    for r in rows:
        if r[0] in inner and re.fullmatch(r"[0-9.eE+-]+", r[2]):
            r[3], r[2] = float(r[2]), ""
    return [tuple(r) for r in rows]


def read(trees: DataFrame, text: str = "value") -> DataFrame:
    """Node rows of every tree in column ``text``; the other columns stay."""
    kept = [c for c in trees.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in trees.schema}

    def run(batches):
        for b in batches:
            found = [nodes(t or "") for t in b.column(text).to_pylist()]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            rows = [r for x in found for r in x]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in kept), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*kept, *(x.split()[0] for x in NODES.split(", "))]
            )

    return trees.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), NODES]))


def write(trees: DataFrame, path: str, *, by: str, text: str = "value") -> None:
    """Trees as text, in a folder of its own for each value of ``by``."""
    trees.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)
