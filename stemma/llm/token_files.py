"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents one after another, and two
Elias-Fano sequences: where each document begins, and the documents' ids.  Such
a sequence keeps the low bits of each number as they are and the high bits in
unary; a sample of the positions of the unary ones lets ``select`` find any
number without a table of 64-bit offsets.

Layout, little-endian: magic ``STEF``, version, bytes of an id (2 or 4), number
of leading documents without a doc_id, number of ids; then the two sequences
(count, universe, low bits, first value, section lengths, low words, high words,
select samples); then the ids.

Files are written by the tasks under a name of their attempt and renamed, so
that retried or doubled tasks leave one whole file for each range.

Edge cases: a null text is encoded as an empty one and has only the end id; rows
with a null doc_id come first; rows of one doc_id are ordered by a hash of their
text; an empty table writes no file and reads back no rows.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import ready, shared_dir, slices, tidy

MAGIC, VERSION = b"STEF", 1
HEADER = struct.Struct("<4sHHqQ")
SEQUENCE = struct.Struct("<QQQqQQQ")
#: Every so many-th one of the unary part has its position sampled.
SAMPLE = 256
#: Bytes of text that a file is made from.
FILE_BYTES = 24 << 20
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 300_000
#: Characters whose words are looked up at a time.
ENCODE_CHARS = 1_500_000


class EliasFano:
    """A sequence of whole numbers that never decreases."""

    def __init__(self, n: int, universe: int, low_bits: int, first: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.first = n, universe, low_bits, first
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, first = len(values), int(values[0]) if len(values) else 0
        x = (values - first).astype(np.uint64)
        universe = int(x[-1]) + 1 if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part, word, shift = x & np.uint64((1 << bits) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1) if n else 0, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        return cls(n, universe, bits, first, low, high, ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [self.low.astype("<u8").tobytes(), self.high.astype("<u8").tobytes(), self.samples.astype("<u4").tobytes()]
        return SEQUENCE.pack(self.n, self.universe, self.low_bits, self.first, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at ``at``, and where it ends."""
        n, universe, bits, first, *sizes = SEQUENCE.unpack_from(raw, at)
        at += SEQUENCE.size
        parts = []
        for size, kind in zip(sizes, ("<u8", "<u8", "<u4"), strict=True):
            parts.append(np.frombuffer(raw, kind, size // int(kind[2]), at))
            at += size
        return cls(n, universe, bits, first, *parts), at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))
        return (self.low[word] >> shift | np.where(shift > 0, over, np.uint64(0))) & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Number ``i``, found from the nearest sample by counting ones word by word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, value = at >> 6, int(self.high[at >> 6]) >> (at & 63) << (at & 63)
        while left >= (ones := value.bit_count()):
            left -= ones
            word += 1
            value = int(self.high[word])
        for _ in range(left):
            value &= value - 1
        position = (word << 6) + (value & -value).bit_length() - 1
        return self.first + ((position - i) << self.low_bits | int(self._low(np.array([i]))[0]))

    def values(self) -> np.ndarray:
        """All the numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high.astype("<u8").view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        high = (ones - i).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(i)).astype(np.int64) + self.first


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file's bytes from ascending doc_ids, nulls first, and each document's ids."""
    nulls = sum(d is None for d in doc_ids)
    starts = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])])
    head = HEADER.pack(MAGIC, VERSION, width, nulls, int(starts[-1]))
    return b"".join([head, EliasFano.of(starts).to_bytes(), EliasFano.of(np.array(doc_ids[nulls:], np.int64)).to_bytes(), *ids])


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, where each document begins (and the last ends), and the ids."""
    view = memoryview(raw)
    magic, version, width, nulls, total = HEADER.unpack_from(view, 0)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    starts, at = EliasFano.from_bytes(view, HEADER.size)
    docs, at = EliasFano.from_bytes(view, at)
    return [None] * nulls + docs.values().tolist(), starts.values(), np.frombuffer(view, f"<u{width}", total, at)


#: Characters at which Python splits and the tokenizers may not.
_ODD = "\x1c\x1d\x1e\x1f\x85"
#: A word's tail of these is one pre-token of its own; an apostrophe may begin a contraction.
_TAIL = string.punctuation.replace("'", "")


class WordEncoder:
    """Ids by the tokenizers library, which sees each distinct word once.

    White space ends every pre-token of these tokenizers, so a text's ids are
    those of its words.  New words of letters alone are encoded as one text
    and told apart by the mark that a word's last token carries.
    """

    def __init__(self, path: str, width: int = 2):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = f"<u{width}"
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _bytes(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words of letters: lower-case ASCII ones are pre-tokens as they are and go to the model itself."""
        plain, kind = self.model.tokenize, "H" if self.kind == "<u2" else "I"
        self.known.update((w, array(kind, [t.id for t in plain(w)]).tobytes()) for w in words if w.isascii() and w.islower())
        words = [w for w in words if not (w.isascii() and w.islower())]
        joined = " ".join(words)
        if not unicodedata.is_normalized("NFC", joined):
            self.known.update((w, self._bytes(w)) for w in words)
            return
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                self.known.update((w, self._bytes(w)) for w in some)
                continue
            raw, edge = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
            self.known.update(zip(some, (raw[a:b] for a, b in zip(edge, edge[1:], strict=False)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, split = self.known, []
        for t in texts:
            if t and any(c in t for c in _ODD):
                known[t] = self._bytes(t)
                split.append([t])
            else:
                split.append((t or "").split())
        new = set().union(*split).difference(known)
        letters, parts, rest = set(), [], []
        for w in new:
            low = w.lower() if w.isascii() else w  # the tokenizers fold case; beyond ASCII the order of steps could matter
            body = low if low.isalpha() else low.rstrip(_TAIL)
            if not body.isalpha():
                rest.append(w)
                continue
            if body == w:
                letters.add(w)
                continue
            tail = low[len(body) :]
            parts.append((w, body, tail))
            if body not in known:
                letters.add(body)
            if tail and tail not in known:
                known[tail] = self._bytes(tail)
        self._learn(list(letters))
        for w, body, tail in parts:
            known[w] = known[body] + known[tail] if tail else known[body]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.kind).tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, width: int) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file:///") else uri)


def _moved(files: fs.FileSystem, mine: str, to: str) -> None:
    """Rename a finished file; another attempt's equal file goes first where a file system won't replace it."""
    try:
        files.move(mine, to)
    except OSError:
        files.delete_file(to)
        files.move(mine, to)


def write(docs: DataFrame, tokenizer: str, to: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` under ``to`` in ascending doc_id order; returns the written manifest.

    The texts are dealt by ranges of doc_id (and of a hash of the text, should
    one doc_id have very many rows) into about ``file_bytes`` each.  The manifest
    (shard, n_docs, n_ids) is a Parquet table beside the files.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // file_bytes))
    order = ["d", F.xxhash64("t")]

    def run(batches):
        encoder, stop = _encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        for b in batches:
            for part in slices([b], "t", ENCODE_CHARS):
                doc_ids += part["d"]
                ids += [x + stop for x in encoder.encode(part["t"])]
        tidy()
        if not doc_ids:
            return
        shard, raw = TaskContext.get().partitionId(), pack(doc_ids, ids, width)
        files, folder = _opened(to)
        files.create_dir(folder, recursive=True)
        mine = f"{folder}/.{uuid.uuid4().hex}.part"
        with files.open_output_stream(mine) as f:
            f.write(raw)
        _moved(files, mine, f"{folder}/{shard:08d}.stef")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(doc_ids), sum(map(len, ids)) // width)], names=["shard", "n_docs", "n_ids"])

    done = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, "shard bigint, n_docs bigint, n_ids bigint")
    done.write.mode("overwrite").parquet(f"{to}/manifest")
    return spark.read.schema(done.schema).parquet(f"{to}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files under ``path``: doc_id, start, n_tokens, ids_crc32.

    The manifest's running sum, over one short row a file, gives each file's first
    place; ``ids_crc32`` is that of the ids as 32-bit numbers.
    """
    ready(spark)
    manifest = spark.read.schema("shard bigint, n_docs bigint, n_ids bigint").parquet(f"{path}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stef").load(path)
    files = files.select(F.regexp_extract("path", r"(\d+)\.stef$", 1).cast("bigint").alias("shard"), "content")

    def run(batches):
        for b in batches:
            for base, raw in zip(b.column("base").to_pylist(), b.column("content"), strict=True):
                doc_ids, starts, ids = unpack(raw.as_buffer())
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(bases, "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark)
