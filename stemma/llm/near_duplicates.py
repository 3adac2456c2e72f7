"""Near-duplicate classes: MinHash bands for candidates, odd sketches to verify them, full sets to confirm.

A document is the set of its distinct ``n``-word shingles; documents are linked
when the Jaccard similarity of their sets is at least ``percent`` / 100, and a
class is what links connect.  The steps:

1.  One pass gives each text its set's size and 128-bit digest, the hashes of
    its MinHash bands, and its odd sketch: the parity of how many MinHash
    samples fall on each of 512 bits.  Texts with equal sets become one
    representative.
2.  Representatives that share a band are candidates.  A bucket is not expanded
    into pairs: its members are compared with its least member, which usually
    holds the bucket together, and then with one other.
3.  Members of buckets that still hold two classes or more go through an exact
    join: shingles are ordered from rare to frequent, and a pair that is similar
    enough shares one among the first few of both, as many as their sizes allow
    to differ.  So no link between classes is lost.  A shingle that many members
    have among their first is dealt out in blocks of members, and there a pair
    must pass step 4's test to leave the join.
4.  A compared pair must pass the sizes' ratio and the sketches' XOR count before
    its texts are brought together and the full sets confirm it.  Two MinHash
    samples that differ flip two bits at most, so that the limit on the count
    loses a true pair only when its samples differ more than ``MISS`` allows.

The number of bands follows from the threshold: a pair at the threshold shares
no band with a probability below ``MISS``.

Keys that many rows share (a representative that holds a large bucket together, a
node with many links) are broadcast with what belongs to them, or their rows
salted, so that no task gets them all.

Edge cases: texts that are null or wordless have an empty set and are alone; a
text with fewer words than a shingle is one shingle of all of them; a row with a
null doc_id isn't compared, has a null component and is kept; repeated rows of
one doc_id and text are kept or dropped together; rows of one doc_id with
different texts are documents of their own, told apart by ``text_hash``, which
share only the number; an empty table gives no rows; columns of ``docs`` other than
these two play no part; a text must fit into a task's memory.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPLIT, Scratch, cut, discard, hot_keys, join_by, ready, shared_dir, slices, tidy

ROWS = 5
#: Probability with which a pair at the threshold may be missed, for the bands and for the sketches.
MISS = 1e-6
SKETCH_BITS = 512
#: Members with one shingle among their first from which on they are dealt out in blocks, and a block's size.
HOT, HOT_BLOCK = 100, 1000
WORDS_KEPT = 250_000
#: Counters of shingles that order them from rare to frequent.
SLOTS = 1 << 20
_LANES = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)
SIGNATURE = f"id bigint, text_hash bigint, size bigint, k0 bigint, k1 bigint, bands array<bigint>, {', '.join(f'{s} bigint' for s in _LANES)}"


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


@lru_cache
def most_differing(percent: int, samples: int, miss: float = MISS) -> int:
    """The least d so that more than d of the samples of a pair at the threshold differ with probability below ``miss``."""
    p, tail, d = 1 - percent / 100, 0.0, samples
    while d > 0:
        tail += math.comb(samples, d) * p**d * (1 - p) ** (samples - d)
        if tail >= miss:
            return d
        d -= 1
    return 0


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_KNOWN = _Hashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; words are split at ASCII white space, with A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_KNOWN) > WORDS_KEPT:
        _KNOWN.clear()
    ids = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


@lru_cache
def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=20_240_229))
    return rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, samples, dtype=np.uint32)


def minhash(found: np.ndarray, samples: int) -> np.ndarray:
    a, b = _permutations(samples)
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(samples, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        np.minimum(out, (a[:, None] * x[None, at : at + 2048] + b[:, None]).min(1), out=out)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(samples: np.ndarray, rows: int) -> np.ndarray:
    """A row of band hashes for each row of samples."""
    parts = samples.reshape(len(samples), -1, rows).astype(np.uint64)
    h = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        h = _mix(h ^ parts[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The parity bitmaps of the rows of samples, as 64-bit lanes."""
    n, k = samples.shape
    salted = samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))
    at = (_mix(salted) % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    parity = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """A row for each document that has an id: its set's size and digest, band hashes and sketch."""
    samples = bands * rows

    def run(batches):
        for b in batches:
            for part in slices([b], "t", 1_000_000):
                sizes, keys, mins, full = [], [], [], []
                for i, t in enumerate(part["t"]):
                    found = shingles(t, n)
                    sizes.append(len(found))
                    keys.append(struct.unpack("<qq", xxhash.xxh3_128_digest(found.tobytes())) if len(found) else (None, None))
                    if len(found):
                        full.append(i)
                        mins.append(minhash(found, samples))
                band_col: list = [None] * len(sizes)
                lanes = np.zeros((len(sizes), len(_LANES)), np.int64)
                if full:
                    stacked = np.stack(mins)
                    lanes[full] = odd_sketches(stacked)
                    for i, row in zip(full, band_hashes(stacked, rows).tolist(), strict=True):
                        band_col[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part["i"], pa.int64()),
                        pa.array(part["h"], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)),
                        pa.array(band_col, pa.list_(pa.int64())),
                        *(pa.array(lanes[:, j]) for j in range(len(_LANES))),
                    ],
                    names=["id", "text_hash", "size", "k0", "k1", "bands", *_LANES],
                )
        _KNOWN.clear()
        tidy()

    rows_in = docs.select(F.col(doc_id).cast("bigint").alias("i"), text_hash(text).alias("h"), F.col(text).alias("t")).filter("i is not null")
    return rows_in.mapInArrow(run, SIGNATURE)


def text_hash(text: str = "text") -> Column:
    """What tells different texts of one doc_id apart; null texts are empty ones."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _near(left: str, right: str, percent: int, samples: int) -> Column:
    """The cheap test of a pair: sizes that allow the similarity, and sketches that differ little enough."""
    a, b = (lambda c: F.col(f"{left}{c}")), (lambda c: F.col(f"{right}{c}"))
    differing = reduce(lambda x, y: x + y, (F.bit_count(a(s).bitwiseXOR(b(s))) for s in _LANES))
    ratio = F.least(a("size"), b("size")) * 100 >= F.greatest(a("size"), b("size")) * percent
    return ratio & (differing <= 2 * most_differing(percent, samples))


def overlap(a: int, b: int, percent: int) -> int:
    """The least number of common shingles of two sets of these sizes that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(token, at, id, label, size): each member's rarest shingles, as many as a partner may lack, and one more.

    How often shingles occur is counted in ``SLOTS`` slots by hash: a table of fixed
    size, which is broadcast.  Any order that all members share keeps the join
    exact; a good one only keeps it small.
    """
    spark = members.sparkSession
    whole = members.join(texts, "id").select("id", "label", "t")

    def slots(batches):
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column("t").to_pylist():
                counts += np.bincount((shingles(t, n) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "c"])

    table = np.zeros(SLOTS, np.int64)
    found = whole.mapInArrow(slots, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    table[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        counts = shared.value
        for b in batches:
            for i, label, t in zip(*(b.column(c).to_pylist() for c in ("id", "label", "t")), strict=True):
                found = shingles(t, n)
                size = len(found)
                rare = found[np.lexsort((found, counts[(found % np.uint64(SLOTS)).astype(np.int64)]))]
                first = rare[: size - -(-percent * size // 100) + 1].view(np.int64)
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array(range(k), pa.int64()), *(pa.array([x] * k, pa.int64()) for x in (i, label, size))],
                    names=["token", "at", "id", "label", "size"],
                )

    return whole.mapInArrow(run, "token bigint, at bigint, id bigint, label bigint, size bigint")


def _across(prefixes: DataFrame, sketch: DataFrame, percent: int, samples: int) -> DataFrame:
    """Distinct pairs (a, b) of different labels that share a shingle early enough to be similar.

    A shingle that more than ``HOT`` members share is met block by block: each of
    its members goes to all blocks, and only pairs whose sketches agree come out.
    """
    x, y = F.col("x.size"), F.col("y.size")
    least = F.floor(((x + y) * percent + 99 + percent) / (100 + percent)).cast("bigint")
    ratio = F.least(x, y) * 100 >= F.greatest(x, y) * percent
    early = (F.col("x.at") <= x - least) & (F.col("y.at") <= y - least)
    fits = (F.col("x.label") < F.col("y.label")) & ratio & early
    pair = F.col("x.id").alias("a"), F.col("y.id").alias("b")

    of = prefixes.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    shared = prefixes.join(of.select("token", "n"), "token")
    few = shared.filter(F.col("n") <= HOT)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & fits).select(*pair)

    blocks = F.ceil(F.col("n") / HOT_BLOCK)
    hot = shared.filter(F.col("n") > HOT).join(sketch.drop("size"), "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    left = hot.select("*", every).withColumnsRenamed({"own": "g", "other": "h"}).alias("x")
    right = hot.select("*", every).withColumnsRenamed({"own": "h", "other": "g"}).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.h") == F.col("y.h"))
    return pairs.union(left.join(right, same & fits & _near("x.", "y.", percent, samples)).select(*pair)).distinct()


def _salted(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (a, b) joined with ``right`` (b, ...): rows of a ``b`` with many pairs are copied, one for every ``SPLIT`` of them."""
    per_b = pairs.groupBy("b").agg(F.count("*").alias("n"))
    hot = hot_keys(per_b)
    if hot is None:
        return pairs.join(right, "b")
    copies = F.broadcast(hot.select("b", F.ceil(F.col("n") / SPLIT).alias("copies")))
    salt = F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1).cast("bigint")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("copies", F.lit(1).cast("bigint")) - 1))
    spread = pairs.join(copies, "b", "left").withColumn("salt", salt).drop("copies")
    return spread.join(right.join(copies, "b", "left").withColumn("salt", each).drop("copies"), ["b", "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        @lru_cache(64)
        def known(t: str) -> np.ndarray:
            return shingles(t, n)

        for b in batches:
            keep = []
            for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
                u, v = shingles(x.as_py(), n), known(y.as_py())
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _KNOWN.clear()
        tidy()

    with_b = _salted(pairs, texts.withColumnsRenamed({"id": "b", "t": "tb"}))
    both = with_b.join(texts.withColumnsRenamed({"id": "a", "t": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, root): the least node that each node of ``edges`` reaches.

    Every round joins all greater neighbours of a node to its least one, and then
    the lesser ones; each round is written out, and the rounds end when none
    changes the edges.  Only a count and a checksum come to the driver.
    """
    spark, folders = edges.sparkSession, [shared_dir(edges.sparkSession)]
    now = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct(), folders[0])
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_by(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # a node's links go to least ones, few each
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        folders.append(shared_dir(spark))
        now = cut(small.select("e.u", "e.v").filter("u > v").distinct(), folders[-1])
        discard(spark, folders.pop(0))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v").distinct())


def _with_label(rows: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """``rows`` with the class of column ``node``: itself where it has no link yet."""
    found = labels.select(F.col("node").alias(node), "root")
    return rows.join(found, node, "left").withColumn("label", F.coalesce("root", node)).drop("root")


def near_duplicates(
    docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash, a row for each row of ``docs``."""
    spark = ready(docs.sparkSession)
    scratch, lasting = Scratch(spark), Scratch(spark)
    bands = bands_for(percent, rows)
    samples = bands * rows
    signed = lasting.cut(signatures(docs, doc_id, text, n, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    # From here on a text is known by the row of the first one with its set.
    first = F.min(F.struct("id", "text_hash", "row"))
    classes = lasting.cut(signed.filter("size > 0").groupBy("k0", "k1").agg(first.alias("f")).select("k0", "k1", F.col("f.row").alias("rep"), "f.id", "f.text_hash"))
    firsts = scratch.cut(signed.drop("id").join(classes.select(F.col("rep").alias("row")), "row").withColumnRenamed("row", "id"))
    sketch = firsts.select("id", "size", *_LANES)

    # Buckets go by a hash of band and value: two that share it only give more candidates.
    in_band = firsts.select("id", F.posexplode("bands").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("key"))
    of_bucket = F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("n")
    shared = scratch.cut(in_band.groupBy("key").agg(*of_bucket).filter("pivot < last").drop("last"))
    members = scratch.cut(join_by(in_band, shared, "key").select("id", "key", "pivot"))
    needed = members.select(F.col("id").alias("rep")).distinct().join(classes, "rep").select("rep", F.col("id").alias("i"), F.col("text_hash").alias("h"))
    whole = docs.select(F.col(doc_id).cast("bigint").alias("i"), text_hash(text).alias("h"), F.coalesce(text, F.lit("")).alias("t"))
    texts = scratch.cut(whole.join(needed.hint("shuffle_hash"), ["i", "h"]).select(F.col("rep").alias("id"), "t"))

    def linked(pairs: DataFrame) -> DataFrame:
        x = sketch.withColumnsRenamed({"id": "a"} | {c: f"x_{c}" for c in sketch.columns[1:]})
        y = sketch.withColumnsRenamed({"id": "b"} | {c: f"y_{c}" for c in sketch.columns[1:]})
        tried = _salted(pairs, y).join(x, "a").filter(_near("x_", "y_", percent, samples)).select("a", "b")
        return _confirmed(scratch.cut(tried), texts, n, percent)

    stars = scratch.cut(members.filter("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    links = scratch.cut(linked(stars))
    labels = scratch.cut(components(links))

    # Buckets of two classes or more: first against another member, then exactly.
    def mixed() -> DataFrame:
        labelled = _with_label(members.drop("pivot"), labels, "id")
        of = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
        return scratch.cut(join_by(labelled, scratch.cut(of.select("key", "n")), "key").drop("n"))

    left = mixed()
    if not left.isEmpty():
        by_hash = F.struct(F.xxhash64("id", "key").alias("h"), "id", "label")
        other = left.groupBy("key").agg(F.min(by_hash).alias("p"), F.count("*").alias("n"))
        second = (
            join_by(left, other, "key")
            .filter("label != p.label")
            .select(F.col("id").alias("a"), F.col("p.id").alias("b"))
            .distinct()
            .join(stars, ["a", "b"], "left_anti")
        )
        links = scratch.cut(links.union(linked(scratch.cut(second))))
        labels = scratch.cut(components(links))
        left = mixed()
    if not left.isEmpty():
        alone = left.select("id", "label").distinct()
        prefixes = scratch.cut(_prefixes(alone, texts, n, percent))
        links = scratch.cut(links.union(linked(scratch.cut(_across(prefixes, sketch, percent, samples)))))
        labels = scratch.cut(components(links))

    roots = _with_label(classes, labels, "rep")
    least = roots.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("n"))
    named = lasting.cut(join_by(roots, least, "label").select("k0", "k1", "component"))
    scratch.clear()
    done = signed.select("id", "text_hash", "size", "k0", "k1").join(named, ["k0", "k1"], "left")
    component = F.coalesce("component", "id")
    out = done.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"), "text_hash"
    )
    none = F.lit(None).cast("bigint")
    nameless = docs.filter(F.col(doc_id).isNull()).select(
        none.alias("doc_id"), none.alias("n_shingles"), none.alias("component_id"), F.lit(True).alias("kept"), text_hash(text).alias("text_hash")
    )
    return out.union(nameless)
