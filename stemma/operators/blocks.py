"""Letters of aligned rows by column, counted a block of columns at a time.

Tasks cut their rows into blocks of columns.  A block's letters leave a task as they
are, or as counts where these are smaller, so that no more than the letters is
shuffled; what belongs to one block of a group is added up in arrays, and only what
``finish`` makes of these becomes rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Columns whose letters stand together.
BLOCK = 4_096
#: Letters that a task gathers before it looks which are counted, and bytes of counts that it holds before it hands them on.
GATHERED, HELD = 8_000_000, 32_000_000
#: Letters that are counted at once, bytes of a batch that leaves a task, and letters' worth of room that a piece takes besides its own.
COUNTED, SENT, ROOM = 500_000, 8_000_000, 100


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Block:
    """Of each letter of a block: how many rows have it in a column, and the sum of their weights."""

    def __init__(self, size: int, weighted: bool, kind: type = np.int64):
        self.size, self.weighted, self.kind = size, weighted, kind
        self.counts: dict[str, tuple[np.ndarray, np.ndarray | None]] = {}

    def of(self, letter: str) -> tuple[np.ndarray, np.ndarray | None]:
        if letter not in self.counts:
            self.counts[letter] = np.zeros(self.size, self.kind), np.zeros(self.size) if self.weighted else None
        return self.counts[letter]

    def add(self, text: str, lengths: np.ndarray, weights: np.ndarray | None) -> None:
        """Pieces of rows, one behind the other."""
        begin = at = 0
        for end in [*(np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // COUNTED)) + 1).tolist(), len(lengths)]:
            n = lengths[begin:end]
            codes = codes_of(text[at : at + int(n.sum())])
            at += len(codes)
            if len(codes):
                col = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
                there = np.bincount(codes) > 0
                letters = np.flatnonzero(there).tolist()
                cell = (np.cumsum(there) - 1)[codes] * self.size + col
                ones = np.bincount(cell, minlength=len(letters) * self.size).reshape(-1, self.size)
                sums = np.bincount(cell, np.repeat(weights[begin:end], n), len(letters) * self.size).reshape(-1, self.size) if self.weighted else None
                for i, letter in enumerate(letters):
                    held = self.of(chr(letter))
                    held[0][:] += ones[i].astype(self.kind)
                    if self.weighted:
                        held[1][:] += sums[i]
            begin = end

    def bytes(self) -> int:
        return len(self.counts) * self.size * (np.dtype(self.kind).itemsize + 8 * self.weighted)

    def arrays(self) -> tuple[list[str], np.ndarray, np.ndarray | None]:
        """The letters in order, and their counts and sums of weights by column."""
        letters = sorted(self.counts)
        n = np.stack([self.counts[c][0] for c in letters]) if letters else np.zeros((0, self.size), self.kind)
        return letters, n, np.stack([self.counts[c][1] for c in letters]) if self.weighted and letters else None


Finish = Callable[[tuple, int, dict[tuple, Block]], "pa.RecordBatch | None"]


def per_block(rows: DataFrame, by: list[str], within: list[str], finish: Finish, schema: str, *, weight: str | None = None, size: int = BLOCK) -> DataFrame:
    """What ``finish`` makes of each group of ``by`` and block of its columns of ``rows`` (by, within, row).

    ``finish`` gets the group's values, the number of the block and, for each value of
    ``within`` in it, its ``Block``.  Null rows count as empty ones, a null weight as 0.
    """
    keys = [*by, *within]
    given = rows.select(*keys, "row") if weight is None else rows.select(*keys, "row", F.col(weight).cast("double").alias("__weight"))
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keys)
    sent = f"{kinds + ', ' if keys else ''}__block int, __counted boolean, __text string, __n binary, __w binary"
    out, fields = to_arrow_schema(StructType.fromDDL(sent)), to_arrow_schema(StructType.fromDDL(schema))

    def gather(batches):
        raw: dict[tuple, list] = defaultdict(list)
        held: dict[tuple, Block] = {}
        ready: list[tuple] = []
        waiting = 0

        def packed():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ready, strict=True), out, strict=True)], schema=out)
            ready.clear()
            return batch

        def settled(last: bool):
            nonlocal waiting
            room = 0
            while raw:
                key, pieces = raw.popitem()
                text = "".join([x for x, _ in pieces])
                lengths = np.array([len(x) for x, _ in pieces], np.int32)
                weights = None if weight is None else np.array([w for _, w in pieces])
                if key in held or len(text) > 4 * len(set(text)) * size:
                    if key not in held:
                        held[key] = Block(size, weight is not None, np.int32)
                    held[key].add(text, lengths, weights)
                else:
                    ready.append((*key, False, text, lengths.tobytes(), None if weights is None else weights.tobytes()))
                    room += len(text) + 12 * len(lengths)
                    if room > SENT:
                        yield packed()
                        room = 0
            waiting = 0
            if last or sum(x.bytes() for x in held.values()) > HELD:
                while held:
                    key, found = held.popitem()
                    letters, n, w = found.arrays()
                    ready.append((*key, True, "".join(letters), n.tobytes(), None if w is None else w.tobytes()))
                    room += found.bytes()
                    if room > SENT:
                        yield packed()
                        room = 0
            if ready:
                yield packed()

        for b in batches:
            groups = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * b.num_rows
            weights = [0.0] * b.num_rows if weight is None else b.column("__weight").to_pylist()
            for group, row, w in zip(groups, b.column("row"), weights, strict=True):
                text = row.as_py() or ""
                for at in range(0, len(text), size):
                    raw[*group, at // size].append((text[at : at + size], w or 0.0))
                    waiting += min(size, len(text) - at) + ROOM
                if waiting > GATHERED:
                    yield from settled(False)
        yield from settled(True)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Block] = {}
        raw: dict[tuple, list] = defaultdict(list)

        def settle(inner: tuple) -> None:
            texts, lengths, weights = zip(*raw.pop(inner), strict=True)
            found[inner].add("".join(texts), np.concatenate(lengths), None if weight is None else np.concatenate(weights))

        waiting: dict[tuple, int] = defaultdict(int)
        for b in batches:
            inners = list(zip(*(b.column(c).to_pylist() for c in within), strict=True)) if within else [()] * b.num_rows
            cols = [b.column(c) for c in ("__counted", "__text", "__n", "__w")]
            for inner, counted, text, n, w in zip(inners, *cols, strict=True):
                text, w = text.as_py(), None if weight is None else np.frombuffer(w.as_buffer())
                block = found.setdefault(inner, Block(size, weight is not None))
                if not counted.as_py():
                    raw[inner].append((text, np.frombuffer(n.as_py(), np.int32), w if w is None else w.copy()))
                    waiting[inner] += len(text)
                    if waiting[inner] > COUNTED:
                        settle(inner)
                        waiting[inner] = 0
                    continue
                n = np.frombuffer(n.as_buffer(), np.int32).reshape(-1, size)
                for i, letter in enumerate(text):
                    held = block.of(letter)
                    held[0][:] += n[i]
                    if w is not None:
                        held[1][:] += w.reshape(-1, size)[i]
        for inner in list(raw):
            settle(inner)
        made = finish(tuple(x.as_py() for x in key[:-1]), key[-1].as_py(), found)
        if made is not None and made.num_rows:
            yield made.select(fields.names).cast(fields)

    return given.mapInArrow(gather, sent).groupBy(*by, "__block").applyInArrow(merge, schema)


def repeated(values: tuple, n: int) -> list[pa.Array]:
    """Each of a group's values ``n`` times."""
    return [pa.nulls(n) if x is None else pa.repeat(pa.scalar(x), n) for x in values]
