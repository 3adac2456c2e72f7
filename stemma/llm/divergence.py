"""Divergence of sources within a language, by systolic rotation.

Terms are runs of letters (ASCII letters in lower case, and all characters beyond
ASCII).  A language keeps the terms of at least ``least`` of its documents.  A
group, a source within a language, has for every kept term the smoothed share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``; a group differs from another by
the sum of ``floor((p - q)**2 / q)`` over all kept terms.

Counting adds up terms in each task before anything is shuffled.  The kept terms of
a language are dealt to shards of about ``SHARD_TERMS``, and a group's counts in a
shard are packed into one compressed vector.  The groups of a language take seats,
``SEAT`` groups each.  A seat's vectors of a shard stay in one partition; those of
its peers come to it in the order of a round-robin tournament, in which each pair
of seats meets once, and the one of them that travels alternates.  A meeting gives
both directions of all its pairs, and a task holds one seat, one visitor and the
language's own vector at a time, however many groups there are.  Heaps of each
vector's partition keep the terms that stand out, which are ranked over all shards.

Edge cases: null text, lang and source are empty strings; each row is a document,
repeated ones too; a group without terms takes part with its smoothed shares; where
a language keeps no term, all divergences are 0; equal values rank by the item's
UTF-8 bytes; very long texts are split into words piece by piece; other columns are
not read; an empty table returns no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, cut, ready, slices

SCALE = 10**9
#: Documents of a language that a kept term is in at least; ranks of terms that are reported.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Terms of a shard, on average; groups of a seat.
SHARD_TERMS, SEAT = 8192, 4
#: Entries that a task counts before it hands them on; bytes of text that are split at a time.
ENTRIES, PIECE = 200_000, 1_000_000
#: Counts up to here can be scaled in 64 bits.
NARROW = (2**63 - 1) // SCALE - 1

_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
VECTOR = "lang string, shard bigint, whole boolean, source string, vector binary, names binary"
FOUND = "lang string, source string, part string, item string, value bigint"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    raw, at = text.encode().translate(_FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and documents with it, by group, added up within the task."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            if words := list(n):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()),
                        pa.array([source] * len(words), pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array(n.values(), pa.int64()),
                        pa.array([docs[w] for w in words], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        found.clear()

    for rows in slices(batches, chars=PIECE):
        for lang, source, text in zip(rows["lang"], rows["source"], rows["text"], strict=True):
            n, docs = found[lang, source]
            seen: set[bytes] = set()
            for words in terms(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in found.values()) > ENTRIES:
            yield from out()
    yield from out()


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts of the kept terms: a row for each group that has one, and a ``whole`` row of the language for each."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_group = named.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    known = by_group.select(
        "lang", "source", "term", "n", F.sum("docs").over(same).alias("docs"), F.sum("n").over(same).alias("all"), F.min("source").over(same).alias("first")
    ).filter(F.col("docs") >= least)
    own = F.struct(F.lit(False).alias("whole"), F.col("source").alias("source"), F.col("n").alias("n"))
    total = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("source"), F.col("all").alias("n"))
    rows = F.when(F.col("source") == F.col("first"), F.array(own, total)).otherwise(F.array(own))
    return known.select("lang", "term", F.explode(rows).alias("r")).select("lang", "term", "r.*")


def seats(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a group: its total, its language's total and number of terms, shards and seats, and the group's seat."""
    totals = counts.groupBy("lang", "whole", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    of_lang = totals.filter("whole").select("lang", F.col("total").alias("lang_total"), F.col("terms").alias("v"))
    of_group = totals.filter("not whole").select("lang", "source", "total")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = {"total": 0, "lang_total": 0, "v": 0}
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return (
        groups.join(of_group, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .fillna(zero)
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD_TERMS)).cast("bigint"))
        .withColumn("seat", F.floor(place / SEAT).cast("bigint"))
        .withColumn("seats", F.ceil(F.count("*").over(Window.partitionBy("lang")) / SEAT).cast("bigint"))
    )


def _packed(group: pa.Table) -> pa.Table:
    """A group's counts in a shard as one compressed row: gaps between the terms' places, and counts; the language's row names the terms too."""
    group = group.sort_by("place")
    place, n = (np.asarray(group.column(c)).astype(np.int64) for c in ("place", "n"))
    press, whole = zstandard.ZstdCompressor(level=3), group.column("whole")[0].as_py()
    names = press.compress("\0".join(group.column("term").to_pylist()).encode()) if whole else None
    first = {c: [group.column(c)[0].as_py()] for c in ("lang", "shard", "whole", "source")}
    pressed = press.compress(np.concatenate([np.diff(place, prepend=0), n]).tobytes())
    return pa.table(first | {"vector": [pressed], "names": [names]}, pa.schema([
        ("lang", pa.string()), ("shard", pa.int64()), ("whole", pa.bool_()), ("source", pa.string()), ("vector", pa.binary()), ("names", pa.binary())
    ]))


def vectors(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The packed counts of each group, and of each whole language, by shard of the terms."""
    shards = groups.select("lang", "shards").distinct()
    dealt = counts.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).drop("shards").repartition("lang", "shard")
    placed = dealt.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    return placed.groupBy("lang", "shard", "whole", "source").applyInArrow(_packed, VECTOR)


def opponent(seat, r, seats):
    """The seat that ``seat`` meets in round ``r`` of the circle method; one past the last is a bye."""
    last = seats + seats % 2 - 1
    other = F.pmod(r - seat, last)
    return F.when(seat == last, F.pmod(r * F.floor((last + 1) / 2), last)).when(other == seat, last).otherwise(other).cast("bigint")


def travels(groups: DataFrame) -> DataFrame:
    """``groups`` with ``stops``: in which round a group's vectors are where; round -1 is at home, the resident row."""
    seat, number = F.col("seat"), F.col("seats")
    rounds = F.sequence(F.lit(0).cast("bigint"), number + number % 2 - 2)
    met = F.transform(rounds, lambda r: F.struct(r.alias("round"), opponent(seat, r, number).alias("host")))
    away = F.filter(met, lambda x: (x["host"] < number) & ((x["host"] > seat) == ((x["host"] + seat) % 2 == 0)))
    home = F.array(F.struct(F.lit(-1).cast("bigint").alias("round"), seat.alias("host")))
    return groups.withColumn("stops", F.concat(home, away))


def shares(n: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / (total + v)), exact for counts of any size."""
    wide = n > NARROW
    out = 1 + SCALE * (np.where(wide, 0, n) + 1) // (total + v) if total + v <= 2**62 else np.zeros(len(n), np.int64)
    for i in range(len(n)) if total + v > 2**62 else np.flatnonzero(wide):
        out[i] = 1 + SCALE * (int(n[i]) + 1) // (total + v)
    return out


def _unpacked(pressed: bytes | None, size: int | None = None) -> np.ndarray:
    """Counts by place; without ``size``, a whole language's, which has every place."""
    if pressed is None:
        return np.zeros(size or 0, np.int64)
    gaps, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(pressed), np.int64).reshape(2, -1)
    if size is None:
        return n
    out = np.zeros(size, np.int64)
    out[np.cumsum(gaps)] = n
    return out


def difference(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """The divergence of p from q, and of q from p."""
    square = (p - q) ** 2
    return int((square // q).sum()), int((square // p).sum())


def outstanding(n: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> list[tuple[int, int]]:
    """The ``top`` largest (value, place) of terms that the group has, and more often than the language; ties by place."""
    at = np.flatnonzero((n > 0) & (p > q))
    value = (p[at] - q[at]) ** 2 // q[at]
    return [(-v, i) for v, i in heapq.nsmallest(top, zip((-value).tolist(), at.tolist(), strict=True))]


def rotation(top: int):
    """The kernel: rows come by (lang, shard, host, round), the language's own first, then residents, then visitors."""

    def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, residents, size, whole, names = None, [], 0, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                lang, source, v = row["lang"], row["source"], row["v"]
                if (here := (lang, row["shard"], row["host"])) != at:
                    at, residents, size, whole, names = here, [], 0, None, []
                if row["round"] == -2:
                    n = _unpacked(row["vector"])
                    size, whole = len(n), shares(n, row["total"], v)
                    names = zstandard.ZstdDecompressor().decompress(row["names"]).decode().split("\0") if size else []
                    continue
                n = _unpacked(row["vector"], size)
                p = shares(n, row["total"], v)
                for peer, q in residents:
                    ours, theirs = difference(p, q)
                    out += [(lang, source, "pair", peer, ours), (lang, peer, "pair", source, theirs)]
                if row["round"] == -1:
                    residents.append((source, p))
                    if size:
                        out += [(lang, source, "term", names[j], value) for value, j in outstanding(n, p, whole, top)]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return meetings


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])


def tournament(groups: DataFrame, packed: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """All divergences of pairs, a row for each shard, and the first terms of each group and shard."""
    spread = travels(groups).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    own = packed.filter("not whole").select("lang", "shard", "source", "vector")
    cells = (
        spread.join(own, ["lang", "shard", "source"], "left")
        .withColumn("s", F.explode("stops"))
        .select("lang", "shard", "s.host", "s.round", "source", "total", "v", "vector", F.lit(None).cast("binary").alias("names"))
    )
    tables = packed.filter("whole").select("lang", "shard", "vector", "names")
    hosts = spread.select("lang", "shard", F.col("seat").alias("host"), F.col("lang_total").alias("total"), "v").distinct()
    first = hosts.join(tables, ["lang", "shard"]).select(
        "lang", "shard", "host", F.lit(-2).cast("bigint").alias("round"), F.lit("").alias("source"), "total", "v", "vector", "names"
    )
    met = cells.unionByName(first).repartition("lang", "shard", "host").sortWithinPartitions("lang", "shard", "host", "round", "source")
    return met.mapInArrow(rotation(top), FOUND)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each group against every other of its language, and its ``top`` terms against the language.

    Ranks count from 1 in each group and part, by value from the largest and then by item.
    """
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark)
    counts = scratch.cut(kept_counts(docs, least))
    groups = scratch.cut(seats(docs, counts))
    packed = scratch.cut(vectors(counts, groups))
    found = cut(tournament(groups, packed, top).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    scratch.clear()
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda part: found.filter(F.col("part") == part).withColumn("rank", F.row_number().over(order))
    return ranked("pair").unionByName(ranked("term").filter(F.col("rank") <= top))
