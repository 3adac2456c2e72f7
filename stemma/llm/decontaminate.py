"""Benchmark decontamination with a broadcast set of normalised test n-grams.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words
is one window.  Words are runs of ASCII letters and digits and of any character
beyond ASCII, with A-Z lower-cased.  A document word is hit if it lies inside
any occurrence of a window.

A benchmark within ``BROADCAST_BYTES`` is broadcast whole.  A larger one is not:
its windows are a table, and of it a bitmap of fixed size alone is broadcast.  One
pass over the texts emits the windows whose bit is set; these join the table, by
the words themselves, and what is found joins the texts.  Both ways give the same.

Edge cases: null or wordless texts have no words and no hits; null, empty or
wordless items have no windows; item ids may be of any type and are told by their
string; repeated items count once; a null item id is skipped; an empty benchmark
hits nothing; repeated rows, and texts that are equal, have equal hits; a text must
fit into a task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Scratch, join_by, ready, slices, tidy

#: Every byte that cannot be in a word becomes a space, and A-Z become a-z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 10
#: Benchmark bytes that one broadcast may hold, and the bits that stand for the windows of a larger one.
BROADCAST_BYTES, BITS = 4 << 20, 1 << 26
#: Words whose hashes a task keeps.
HELD_WORDS = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point offsets of the words, end exclusive."""
    raw = text.encode()
    folded = raw.translate(FOLD)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    spans, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        spans.append((int(points[at]), int(points[at + len(w)])))
        at += len(w)
    return spans


class Windows:
    """The benchmark's windows: a hash set by window length, with the words for verification."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.found: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text))
            if ids:
                k = min(n, len(ids))
                kept = self.found.setdefault(k, {})
                for i in range(len(ids) - k + 1):
                    owners = kept.setdefault(ids[i : i + k], [])
                    if not owners or owners[-1] != item:
                        owners.append(item)
        self.hashes = {k: np.unique(self._hash(np.array(list(v), dtype=np.int64), k)) for k, v in self.found.items()}

    @staticmethod
    def _hash(rows: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(len(rows), np.uint64)
            for j in range(k):
                h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
                h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Hit mask over the words, and the items with occurring windows."""
        hit, items = np.zeros(len(words), bool), set()
        if not words or not self.found:
            return hit, items
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for k, hashes in self.hashes.items():
            if len(ids) < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            rows = ids[starts[:, None] + np.arange(k)]
            h = self._hash(rows, k)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == h):
                owners = self.found[k].get(tuple(rows[i].tolist()))
                if owners:  # the words themselves, not only their hash
                    hit[starts[i] : starts[i] + k] = True
                    items.update(owners)
        return hit, items


_BUILT: list = [None, 0, None]


def _windows_of(items: list[tuple[str, str]], n: int) -> Windows:
    """The windows of a broadcast benchmark, made once in each Python worker."""
    if _BUILT[0] is not items or _BUILT[1] != n:
        _BUILT[:] = items, n, Windows(items, n)
    return _BUILT[2]


NEW = "n_words bigint, n_hit bigint, hit_items array<string>, clean_text string"


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (sorted as strings) and ``clean_text``.

    ``clean_text`` is the text with every run of hit words cut out.  All columns
    of ``docs`` stay in front; a column of theirs with one of the new names is
    replaced.
    """
    spark = ready(docs.sparkSession)
    new = StructType.fromDDL(NEW)
    kept = docs.drop(*new.names)
    out = StructType([*kept.schema, *new])
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > limit:
        return _joined(kept, items, text, n, out)
    shared = spark.sparkContext.broadcast(sorted((r.i, r.t) for r in items.collect()))

    def run(batches):
        windows = _windows_of(shared.value, n)
        for b in batches:
            found = []
            for part in slices([b.select([text])], text):
                for t in part[text]:
                    words = words_of(t)
                    mask, some = windows.scan(words)
                    found.append(_row(t, len(words), np.flatnonzero(mask).tolist(), some))
            yield _with_hits(b, found)
        tidy()

    return kept.mapInArrow(run, out)


def _row(text: str | None, n_words: int, hit: list[int], items) -> tuple[int, int, list[str], str | None]:
    return n_words, len(hit), sorted(items), without(text, hit) if hit else text


def _with_hits(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 4
    kinds = pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()
    names = ["n_words", "n_hit", "hit_items", "clean_text"]
    return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*b.schema.names, *names])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(words: list[bytes], k: int, known: _Hashes) -> np.ndarray:
    """The hash of each ``k`` consecutive words."""
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + len(h)]) * MULTIPLIER
        h ^= h >> np.uint64(32)
    return h


def _joined(docs: DataFrame, items: DataFrame, text: str, n: int, out: StructType) -> DataFrame:
    """``hits`` for a benchmark of any size."""
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def windows(batches):
        known = _Hashes()
        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                words = words_of(t)
                k = min(n, len(words))
                h = window_hashes(words, k, known).view(np.int64) if k else []
                strings = [b" ".join(words[j : j + k]).decode() for j in range(len(h))]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.int32()), pa.array(h, pa.int64()), pa.array(strings, pa.string()), pa.array([i] * len(h), pa.string())], names=["k", "h", "words", "item"])

    table = items.mapInArrow(windows, "k int, h bigint, words string, item string").groupBy("h", "words", "k").agg(F.collect_set("item").alias("items"))
    table = scratch.cut(table)
    lengths = sorted(r.k for r in table.select("k").distinct().collect())
    lanes = table.select(F.pmod("h", F.lit(BITS)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("bigint").alias("lane"))
    lanes = lanes.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    # Texts are told by two hashes, so that equal ones share what is found.
    of_text = F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("y")

    def seen(batches):
        bits, known = shared.value.view(np.uint64), _Hashes()
        for b in batches:
            for x, y, t in zip(*(b.column(c).to_pylist() for c in ("x", "y", "t")), strict=True):
                words = words_of(t)
                for k in lengths:
                    h = window_hashes(words, k, known).view(np.int64)
                    bit = np.mod(h, BITS).astype(np.uint64)
                    at = np.flatnonzero(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        some = [pa.array([v] * len(at), pa.int64()) for v in (x, y)]
                        strings = pa.array([b" ".join(words[j : j + k]).decode() for j in at.tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([*some, pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(h[at]), strings], names=["x", "y", "k", "at", "h", "words"])
        tidy()

    rows = docs.select(*of_text, F.col(text).alias("t"))
    asked = scratch.cut(rows.mapInArrow(seen, "x bigint, y bigint, k int, at bigint, h bigint, words string").distinct())
    known = asked.groupBy("h").agg(F.count("*").alias("n")).join(table.withColumnsRenamed({"words": "w", "k": "len"}), "h")
    found = join_by(asked, known, "h").filter("words = w and k = len")
    per_text = Scratch(spark).cut(
        found.select("x", "y", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("place"), "items")
        .groupBy("x", "y")
        .agg(F.array_sort(F.collect_set("place")).alias("__hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"))
    )
    scratch.clear()

    def finish(batches):
        for b in batches:
            found = [
                _row(t, len(words_of(t)), hit or [], some or [])
                for t, hit, some in zip(*(b.column(c).to_pylist() for c in (text, "__hit", "__items")), strict=True)
            ]
            yield _with_hits(b.drop_columns(["__hit", "__items"]), found)
        tidy()

    both = docs.select("*", of_text[0].alias("__x"), of_text[1].alias("__y")).join(per_text.withColumnsRenamed({"x": "__x", "y": "__y"}), ["__x", "__y"], "left")
    return both.drop("__x", "__y").mapInArrow(finish, out)


def without(text: str, hit: list[int]) -> str:
    """``text`` without its words numbered in ``hit``; what lies between two hit words goes too."""
    spans, gone = word_spans(text), set(hit)
    kept, at = [], 0
    for i, (start, end) in enumerate(spans):
        if i in gone:
            if i - 1 not in gone:
                kept.append(text[at:start])
            at = end
    return "".join([*kept, text[at:]])
