"""Byte-level BPE encoding of overlapping chunks, and decoding.

A text up to ``chunk`` characters is encoded where it lies.  A longer one is cut
into chunks that overlap; the chunks are dealt over the cluster and pre-tokenised
in parallel.  A chunk may begin inside a pre-token, so its first boundaries can
be wrong; but from the first boundary that it shares with its predecessor on,
both must agree, as the pattern looks only ahead.  There the texts are stitched,
and the pieces between stitches are encoded in parallel.  Chunks without a shared
boundary (a pre-token longer than the overlap) are joined before encoding.
Decoding concatenates the raw bytes of the ids.

Edge cases: a null text is encoded as an empty one: no ids, no bytes.  Repeated
rows are encoded separately; rows need no unique key.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import ready, slices, tidy

#: Characters of a chunk, and those that it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Characters that the pattern's fixed alternatives may look ahead.
AHEAD = 4
ENCODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding, made once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = load(path, pattern)
    return _LOADED[path, pattern]


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(first character, slice): each slice runs ``overlap`` characters into the next one."""
    for start in range(0, max(1, len(text)), chunk):
        yield start, text[start : start + chunk + overlap]


def boundaries(piece: str, pattern: regex.Pattern, start: int) -> list[int]:
    """Text positions at which a pre-token begins behind something else than white space.

    Matches near the end of the slice could change with what follows, so the
    last ``AHEAD`` characters don't count.  Boundaries behind white space are left
    out: there the pattern looks past the run, and a piece that ends in one would
    be split in another way.  All others hold in scripts without blanks too, where
    marks between letters make them.
    """
    return [start + at for m in pattern.finditer(piece) if 0 < (at := m.start()) <= len(piece) - AHEAD and not piece[at - 1].isspace()]


def _cut(text: str, chunk: int, overlap: int):
    """One row for each chunk of the texts; the first has the text's other columns."""

    def run(batches):
        for b in batches:
            rest = b.column("__rest")
            for i, row in enumerate(b.column("__row").to_pylist()):
                pieces = list(chunks(b.column(text)[i].as_py(), chunk, overlap))
                for k, (start, piece) in enumerate(pieces):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row], pa.int64()),
                            rest.slice(i, 1) if k == 0 else pa.nulls(1, rest.type),
                            pa.array([k], pa.int64()),
                            pa.array([start], pa.int64()),
                            pa.array([piece], pa.string()),
                        ],
                        names=["__row", "__rest", "k", "start", "piece"],
                    )

    return run


def _heads_and_tails(pattern: str, chunk: int, overlap: int):
    def run(batches):
        compiled = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for start, piece in zip(b.column("start").to_pylist(), b.column("piece").to_pylist(), strict=True):
                found = boundaries(piece, compiled, start)
                heads.append([x for x in found if x < start + overlap])
                tails.append([x for x in found if x > start + chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*b.schema.names, "heads", "tails"],
            )

    return run


def _encode_pieces(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("__row", "__rest", "group")),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([",".join(map(str, x)) for x in ids], pa.string()),
                    pa.array([enc.decode_bytes(x) for x in ids], pa.binary()),
                ],
                names=["__row", "__rest", "group", "n", "ids", "raw"],
            )

    return run


def _encode_rows(text: str, path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for part in slices([b.select([text])], text):
                for t in part[text]:
                    ids = enc.encode_ordinary(t or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            keep = [c for c in b.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        tidy()

    return run


def stitched(long: DataFrame, pattern: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The texts of ``long`` (__row, __rest, text) cut at shared boundaries: __row, __rest, group, piece.

    The chunks move once, dealt by text and number; only then do a text's chunks
    meet in windows that compare their boundaries.  A chunk is stitched where
    all chunks before it were: behind a failure its own boundaries are unproven,
    so the rest of that text is one piece.
    """
    rest = long.schema["__rest"].dataType
    cut_type = StructType.fromDDL("__row bigint, k bigint, start bigint, piece string")
    cut_type = StructType([cut_type["__row"], StructField("__rest", rest), *list(cut_type)[1:]])
    marks = StructType([*cut_type, *StructType.fromDDL("heads array<bigint>, tails array<bigint>")])
    marked = (
        long.mapInArrow(_cut(text, chunk, overlap), cut_type)
        .repartition("__row", "k")
        .mapInArrow(_heads_and_tails(pattern, chunk, overlap), marks)
    )
    by_text = Window.partitionBy("__row").orderBy("k")
    shared = F.array_min(F.array_intersect(F.lag("tails").over(by_text), "heads"))
    begins = marked.withColumn("begin", F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(shared))
    begins = begins.drop("heads", "tails").withColumn(
        "begin", F.when(F.min(F.col("begin").isNotNull()).over(by_text), F.col("begin"))
    )
    last = F.col("start") + F.length("piece")
    parts = begins.select(
        "__row",
        "__rest",
        "k",
        "piece",
        "start",
        (F.count("begin").over(by_text) - 1).alias("group"),
        F.coalesce("begin", "start").alias("from"),
        F.coalesce(F.lead(F.coalesce("begin", "start")).over(by_text), last).alias("to"),
    )
    part = F.expr("substring(piece, cast(`from` - start as int) + 1, cast(`to` - `from` as int))")
    whole = F.expr("array_join(transform(array_sort(collect_list(struct(k, part))), x -> x.part), '')")
    return (
        parts.withColumn("part", part)
        .groupBy("__row", "group")
        .agg(F.first("__rest", ignorenulls=True).alias("__rest"), whole.alias("piece"))
    )


def encode_decode(
    docs: DataFrame, path: str, pattern: str, *, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and the digests of its ids and of the bytes decoded from them.

    Columns of ``docs`` with these names are replaced.
    """
    ready(docs.sparkSession)
    new = StructType.fromDDL(ENCODED)
    kept = docs.drop(*new.names)
    rest = StructType([f for f in kept.schema if f.name != text])
    short = kept.filter(F.col(text).isNull() | (F.length(text) <= chunk))
    near = short.mapInArrow(_encode_rows(text, path, pattern), StructType([*rest, *new]))
    long = kept.filter(F.length(text) > chunk).select(
        F.monotonically_increasing_id().alias("__row"),
        F.struct(F.lit(True).alias("__kept"), *(F.col(c) for c in rest.names)).alias("__rest"),
        text,
    )
    pieces = stitched(long, pattern, text, chunk, overlap)
    kinds = [pieces.schema[c] for c in ("__row", "__rest", "group")]
    kinds = StructType([*kinds, *StructType.fromDDL("n bigint, ids string, raw binary")])
    ids = pieces.mapInArrow(_encode_pieces(path, pattern), kinds)
    ordered = F.expr("array_sort(collect_list(struct(group, n, ids, raw)))")
    far = (
        ids.groupBy("__row")
        .agg(F.first("__rest", ignorenulls=True).alias("r"), ordered.alias("p"))
        .select(
            *(F.col(f"r.`{c}`") for c in rest.names),
            F.expr("aggregate(p, 0L, (a, x) -> a + x.n)").alias("n_tokens"),
            F.sha2(F.expr("array_join(transform(p, x -> x.ids), ',')"), 256).alias("ids_sha256"),
            F.sha2(F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.raw))"), 256).alias("decoded_sha256"),
        )
    )
    return near.unionByName(far)
