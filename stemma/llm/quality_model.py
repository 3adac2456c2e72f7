"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is of words, two at a time; words are known by 48-bit hashes.  Its counts
are gathered from all trusted text, grow with it, and stay sharded by n-gram: no
table of it is broadcast or collected, only its counts of counts.  To score, each
task gathers the distinct n-grams of a block of texts and asks each shard for its
part, packed in one row, so that a join of counts moves a few bytes for an n-gram.
What the shards answer meets the block again, which travels compressed.

A text is rejected when its perplexity lies beyond a quantile of what trusted text
of its language shows, by a margin.  The quantiles are taken over trusted texts
that the model was not trained on; a language's are drawn towards those of all
languages by a weight of ``LEAST_TEXTS`` texts, so that rare ones aren't left to chance.

Edge cases: a null, empty or blank text has no perplexity and is rejected; a null
language, or one without held-out trusted texts, is judged by the quantiles of all;
with no trusted text at all nothing is judged and every text with words is kept;
repeated rows are scored alike; an empty table gives no rows; letters of scripts
that are written without blanks are words of their own; a very long text is a block
of its own, so it must fit into a task's memory; columns of ``docs`` with one of the
new names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ._common import blocks_of, cut, discard, named_block, packed, ready, shared_dir, slices, tidy

#: Bits of a word's and of a pair's hash.
KEY_BITS = 48
#: The number of words among which an unknown one is one.
CLASSES = 1 << 20
#: Bytes of text to a shard of the counts.
SHARD_BYTES = 32 << 20
#: Bytes of scored text, on a shard's part, whose questions to the shard are answered in one group.
ASKED_BYTES = 96 << 20
#: Different words whose hashes a task keeps, and words that are counted at a time.
HELD_WORDS, PART_WORDS = 500_000, 3_000_000
#: Words of a block's line whose pairs are made, or looked up, at a time.
LINE_PART = 1 << 18
#: The share of trusted texts that set the quantiles and train nothing: one in so many.
HELD_OUT = 10
#: Quantile of the held-out trusted log-perplexities, how far beyond it a text may lie, and the median's weight in words.
HIGH, MARGIN, PRIOR = 0.99, 0.05, 40
#: Trusted ids, and languages with limits of their own, that may be broadcast.
BROADCAST_IDS, BROADCAST_LANGUAGES = 1_000_000, 10_000
#: Texts of all languages that a language's own held-out texts are weighed against.
LEAST_TEXTS = 50

# Thai, Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = re.compile("[ก-໿က-႟ក-៿ぁ-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
ADDED = ("perplexity", "n_words")
PACKED = "shard bigint, keys binary, values binary"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.split()


class Words(dict):
    """Hashes of words; every digit is a nought.  0 stands before a text and 1 at its end."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        plain = "".join("0" if "0" <= c <= "9" else c for c in word)
        self[word] = h = max(2, xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) >> (64 - KEY_BITS))
        return h


def line_of(texts: Iterable[str | None], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words in one line, each text between a 0 and a 1, and how many words and ends each has."""
    line, sizes = [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words) + 1 if words else 0)
        if words:
            line.append(0)
            line.extend(map(known.__getitem__, words))
            line.append(1)
    return np.array(line, np.uint64), np.array(sizes, np.int64)


def pairs_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word and each text's end, with the word before it."""
    here = np.flatnonzero(line)
    return line[here - 1], line[here]


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = before * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) >> np.uint64(64 - KEY_BITS)


def placed_pairs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words and the texts' ends of a block's line stand, in four bytes each, and the keys of their pairs, made a part at a time."""
    here = np.empty(np.count_nonzero(line), np.int32)
    keys, n = np.empty(len(here), np.uint64), 0
    for at in range(0, len(line), LINE_PART):
        some = np.flatnonzero(line[at : at + LINE_PART]) + at
        here[n : n + len(some)], keys[n : n + len(some)] = some, pair_keys(line[some - 1], line[some])
        n += len(some)
    return here, keys


# --- packed rows -------------------------------------------------------------------------------


def squeezed(values: np.ndarray) -> bytes:
    """Compressed, all first bytes in front, as the high ones are alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def restored(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences: their low bytes as they are, the highest compressed."""
    steps = np.diff(keys)
    low = max(0, (int(steps.max(initial=0)).bit_length() - 1) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)
    high = pa.compress(np.ascontiguousarray(planes[:, low]), codec="zstd", asbytes=True)
    head = np.array([keys[0], len(steps), low, len(high)], np.uint64)
    return head.tobytes() + high + planes[:, :low].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    first, n, low, size = np.frombuffer(raw, np.uint64, 4).tolist()
    out = np.zeros((n + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8)
    out[1:, low] = np.frombuffer(pa.decompress(raw[32 : 32 + size], n, codec="zstd"), np.uint8)
    out[1:, :low] = np.frombuffer(raw, np.uint8, offset=32 + size).reshape(n, low)
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def in_shards(keys: np.ndarray, shards: int) -> Iterable[tuple[int, slice]]:
    """Where each shard's part of ascending keys lies; shards divide the keys' range evenly."""
    of = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)
    ends = np.flatnonzero(np.diff(of, append=np.uint64(shards))) + 1 if len(keys) else []
    at = 0
    for end in ends:
        yield int(of[at]), slice(at, int(end))
        at = int(end)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


# --- training ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Packed counts (shard, keys, values): words in the first ``shards`` shards, pairs in the next; and what holds for all."""

    table: DataFrame
    shards: int
    of_words: tuple[float, float, float]
    of_pairs: tuple[float, float, float]
    n_pairs: int
    left: float
    folders: tuple[str, ...]


_TRAINED = f"{PACKED}, n bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"
_TRAINED_ROWS = [("shard", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())] + [(c, pa.int64()) for c in ("n", "n1", "n2", "n3", "n4")]
#: A word's sums: how often it goes before another, how many it goes before once, twice and more often, and how many go before it.
SUMS = 5


def _classes(counts: np.ndarray) -> list[int]:
    return [int((counts > 0).sum()), *(int((counts == i).sum()) for i in (1, 2, 3, 4))]


def _count_pairs(shards: int, text: str):
    """Rows for a shard: the pairs of a part of the texts and how often each occurs there."""
    schema = [("shard", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("before", "word", "count"))]

    def emitted(held):
        before, word = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        keys, first, count = np.unique(pair_keys(before, word), return_index=True, return_counts=True)
        rows = []
        for shard, at in in_shards(keys, shards):
            b, w, c = before[first[at]], word[first[at]], count[at].astype(np.uint32)
            order = np.argsort(b, kind="stable")
            rows.append((shard, len(b), squeezed(b[order]), squeezed(w[order]), squeezed(c[order])))
        return _batch(rows, schema)

    def run(batches):
        held, size, known = [], 0, Words()
        for part in slices(batches, text):
            held.append(pairs_of(line_of(part[text], known)[0]))
            size += len(held[-1][0])
            if size >= PART_WORDS:
                yield emitted(held)
                held, size = [], 0
        if size:
            yield emitted(held)
        tidy()

    return run


def _sum_pairs(shards: int):
    """A shard's pairs with their counts in all texts, and what they add to the words' sums, a row for each shard of these."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        before, word = (np.concatenate([restored(r[c], "u8", r["n"]) for r in rows]) for c in ("before", "word"))
        count = np.concatenate([restored(r["count"], "u4", r["n"]) for r in rows])
        keys, first, inverse = np.unique(pair_keys(before, word), return_index=True, return_inverse=True)
        count = np.bincount(inverse, count, len(keys)).astype(np.uint64)
        before, word = before[first], word[first]
        out = [(shards + rows[0]["shard"], pack(keys), squeezed(count), *_classes(count))]
        words, at = np.unique(np.concatenate([before, word]), return_inverse=True)
        of_before, of_word = at[: len(before)], at[len(before) :]
        adds = [(of_before, count), *((of_before, x) for x in (count == 1, count == 2, count > 2)), (of_word, np.ones(len(word)))]
        sums = np.stack([np.bincount(i, x, len(words)) for i, x in adds]).astype(np.uint64)
        out += [(shard, pack(words[at]), squeezed(sums[:, at]), at.stop - at.start, 0, 0, 0, 0) for shard, at in in_shards(words, shards)]
        tidy()
        return pa.Table.from_batches([_batch(out, _TRAINED_ROWS)])

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    """A shard's words with their sums over all shards of pairs."""
    rows = table.to_pylist()
    words, inverse = np.unique(np.concatenate([unpack(r["keys"]) for r in rows]), return_inverse=True)
    parts = np.concatenate([restored(r["values"], "u8", SUMS * r["n"]).reshape(SUMS, -1) for r in rows], axis=1)
    sums = np.stack([np.bincount(inverse, x, len(words)) for x in parts]).astype(np.uint64)
    tidy()
    return pa.Table.from_batches([_batch([(rows[0]["shard"], pack(words), squeezed(sums), *_classes(sums[-1]))], _TRAINED_ROWS)])


def train(trusted: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """The model of all ``trusted`` texts, its counts written to the shared folder."""
    ready(trusted.sparkSession)
    if shards is None:
        size = trusted.agg(F.sum(F.octet_length(text))).first()[0] or 0
        shards = 8 + size * 3 // SHARD_BYTES
    parts = trusted.select(text).mapInArrow(_count_pairs(shards, text), "shard bigint, n bigint, before binary, word binary, count binary")
    spark = trusted.sparkSession
    to, also = shared_dir(spark), shared_dir(spark)
    first = parts.groupBy("shard").applyInArrow(_sum_pairs(shards), _TRAINED).withColumn("pairs", (F.col("shard") >= shards).cast("int"))
    first = cut(first, to, ("pairs",))
    of_pairs = first.filter("pairs = 1")
    of_words = cut(first.filter("pairs = 0").drop("pairs").groupBy("shard").applyInArrow(_sum_words, _TRAINED), also)
    discard(spark, f"{to}/pairs=0")
    sums = [t.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n1", "n2", "n3", "n4"))).first() for t in (of_words, of_pairs)]
    d1, d2 = (discount(s.n1, s.n2, s.n3, s.n4) for s in sums)
    left = d1[0] * sums[0].n1 + d1[1] * sums[0].n2 + d1[2] * (sums[0].n - sums[0].n1 - sums[0].n2)
    names = ("shard", "keys", "values")
    return Model(of_words.select(*names).union(of_pairs.select(*names)), shards, d1, d2, sums[1].n, left, (to, also))


def discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; plain ones where a small corpus lacks any."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), least) for d, least in zip(found, (0.95, 1.95, 2.95), strict=True))


def _cost(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


# --- scoring -----------------------------------------------------------------------------------


def _mark(words: np.ndarray, pairs: np.ndarray) -> int:
    h = xxhash.xxh3_64(words.tobytes())
    h.update(pairs.tobytes())
    return h.intdigest() - (1 << 63)


def distinct_of(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, from one sorted copy."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them, in four bytes; no table of all keys lies beside them."""
    distinct = distinct_of(keys)
    places = np.empty(len(keys), np.int32)
    for at in range(0, len(keys), LINE_PART):  # a part in its order, so that what is looked up lies side by side
        order = np.argsort(keys[at : at + LINE_PART])
        places[at + order] = np.searchsorted(distinct, keys[at + order])
    return distinct, places


def _block_line(parts, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's texts in one line, and the sizes of those of each part."""
    known, lines, sizes = Words(), [], []
    for p in parts:
        line, n = line_of(p.column(text).to_pylist(), known)
        lines.append(line)
        sizes.append(n)
    whole, at = np.empty(sum(map(len, lines)), np.uint64), 0
    for i, line in enumerate(lines):  # a part goes as soon as it has been copied
        whole[at : at + len(line)] = line
        at, lines[i] = at + len(line), None
    return whole, sizes


def _asks(shards: int, text: str):
    """A block's distinct n-grams, in a row for each shard that may know some."""
    schema = [("shard", pa.int64()), ("block", pa.int64()), ("mark", pa.int64()), ("asked", pa.binary())]

    def run(batches):
        for i, parts in enumerate(blocks_of(batches, text)):
            line, _ = _block_line(parts, text)
            words, pairs = distinct_of(line), distinct_of(placed_pairs(line)[1])
            name, mark = named_block(i), _mark(words, pairs)
            rows = [(k * shards + shard, name, mark, pack(keys[at])) for k, keys in enumerate((words, pairs)) for shard, at in in_shards(keys, shards)]
            yield _batch(rows, schema)
        tidy()

    return run


def _answers(model: Model):
    """What a shard knows of the n-grams asked for, in their order, 0 of others.

    Of a pair its count; of a word how often it goes before others, the weight that
    this leaves to single words, and its own probability.
    """
    schema = [("block", pa.int64()), ("shard", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("found", pa.binary())]
    shards, d1, d2, n_pairs, left = model.shards, model.of_words, model.of_pairs, max(1, model.n_pairs), model.left

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([_batch([], schema)])
        pairs = asked.column("shard")[0].as_py() >= shards
        keys, values = np.empty(0, np.uint64), np.zeros((1 if pairs else 3, 0), "<f4")
        for r in known.to_pylist():
            keys = unpack(r["keys"])
            if pairs:
                values = restored(r["values"], "u8", len(keys)).reshape(1, -1).astype("<u4")
            else:
                total, once, twice, more, before = restored(r["values"], "u8", SUMS * len(keys)).reshape(SUMS, -1)
                rest = (d2[0] * once + d2[1] * twice + d2[2] * more) / np.maximum(total, 1)
                own = (before - _cost(before, d1)) / n_pairs
                values = np.stack([total, rest, own]).astype("<f4")
        out = []
        for r in asked.to_pylist():
            wanted = unpack(r["asked"])
            found = np.zeros((len(values), len(wanted)), values.dtype)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                found[:, hit] = values[:, at[hit]]
            out.append((r["block"], r["shard"], r["mark"], len(wanted), squeezed(found)))
        tidy()
        return pa.Table.from_batches([_batch(out, schema)])

    return run, "block bigint, shard bigint, mark bigint, n bigint, found binary"


def _scored(model: Model, text: str, out: StructType):
    shards, d2 = model.shards, np.array([0.0, *model.of_pairs])
    unknown = (model.left / model.n_pairs if model.n_pairs else 1.0) / CLASSES

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(raw.as_buffer()).read_all() for raw in left.column("part")]
        if not parts:
            raise RuntimeError("a block of texts was read twice and not found again: write the texts out before they are scored")
        line, sizes = _block_line(parts, text)
        # A block's arrays are long: what has been used goes, places take four bytes, and the rest is done a part at a time.
        here, keys = placed_pairs(line)
        words, of_line = placed(line)
        del line
        pairs, of_pair = placed(keys)
        mark, n_pairs = _mark(words, pairs), len(pairs)
        del keys, words, pairs
        answers = sorted(right.to_pylist(), key=lambda r: r["shard"])
        of_words = [restored(r["found"], "f4", 3 * r["n"]).reshape(3, -1) for r in answers if r["shard"] < shards]
        of_pairs = [restored(r["found"], "u4", r["n"]) for r in answers if r["shard"] >= shards]
        if sum(map(len, of_pairs)) != n_pairs or any(r["mark"] != mark for r in answers):
            raise RuntimeError("a block of texts was read twice and differed: write the texts out before they are scored")
        del answers
        total, rest, own = np.concatenate(of_words, axis=1).astype(float) if of_words else np.zeros((3, 0))
        count = np.concatenate(of_pairs) if of_pairs else np.zeros(0, np.uint32)
        some, at = [], 0
        for part, n in zip(parts, sizes, strict=True):
            end = at + int(n.sum())
            before, c = of_line[here[at:end] - 1], count[of_pair[at:end]]
            lower = own[of_line[here[at:end]]] + unknown
            p = np.where(total[before] > 0, (c - d2[np.minimum(c, 3)]) / np.maximum(total[before], 1) + rest[before] * lower, lower)
            some.append(_with_perplexity(part, np.log(p), n))
            at = end
        tidy()
        return pa.concat_tables(some).select(out.names)

    return run


def _with_perplexity(part: pa.Table, each: np.ndarray, sizes: np.ndarray) -> pa.Table:
    full = np.flatnonzero(sizes)
    out: list[float | None] = [None] * len(sizes)
    if len(full):
        sums = np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)])[full])
        for i, x in zip(full.tolist(), np.exp(-sums / sizes[full]).tolist(), strict=True):
            out[i] = x
    return part.append_column(ADDED[0], pa.array(out, pa.float64())).append_column(ADDED[1], pa.array(sizes))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``perplexity``, null where there is no word, and ``n_words``, the text's end included.

    ``docs`` are read twice and must be the same both times, as tables are; a
    checksum of each block's n-grams tells where they aren't, and the job fails.
    """
    ready(docs.sparkSession)
    kept = docs.drop(*ADDED)
    out = StructType([*kept.schema, StructField(ADDED[0], DoubleType()), StructField(ADDED[1], LongType())])
    # What is asked of a shard grows with the texts: it is dealt to as many copies of the shard as keep a group bounded.
    size = kept.agg(F.sum(F.octet_length(text))).first()[0] or 0
    copies = 1 + size // (model.shards * ASKED_BYTES)
    asks = kept.mapInArrow(_asks(model.shards, text), "shard bigint, block bigint, mark bigint, asked binary").withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)))
    known = model.table.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
    run, schema = _answers(model)
    answers = cut(asks.groupBy("shard", "copy").cogroup(known.groupBy("shard", "copy")).applyInArrow(run, schema).filter("n > 0"))

    def packs(batches):
        for i, parts in enumerate(blocks_of(batches, text)):
            name = named_block(i)
            for p in parts:
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([packed(p)], pa.binary())], names=["block", "part"])

    blocks = kept.mapInArrow(packs, "block bigint, part binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model, text, out), out)


# --- judging -----------------------------------------------------------------------------------


def drawn(log: Column, n: Column, mid: Column) -> Column:
    return (log * n + mid * PRIOR) / (n + PRIOR)


def limits(scored: DataFrame, held_out: Column, lang: str = "lang") -> tuple[DataFrame, tuple[float | None, float | None]]:
    """(language, median, limit) of the held-out trusted texts, and median and limit of all languages together.

    Short texts scatter more, so a text's log-perplexity is first drawn towards its
    language's median by the weight of ``PRIOR`` words.  A language's median and
    limit are drawn towards those of all languages by ``LEAST_TEXTS`` texts.
    """
    x = scored.filter(held_out & F.col("perplexity").isNotNull()).select(F.col(lang).alias("__lang"), F.ln("perplexity").alias("l"), "n_words")
    middle = lambda: F.percentile_approx("l", 0.5, 10_000)
    high = lambda mid: F.percentile_approx(drawn(F.col("l"), F.col("n_words"), mid), HIGH, 10_000)
    of_all = x.agg(middle().alias("mid")).first().mid
    if of_all is None:
        return x.select("__lang", F.lit(0.0).alias("__mid"), F.lit(0.0).alias("__limit")), (None, None)
    whole = x.agg(high(F.lit(of_all)).alias("limit")).first().limit + MARGIN
    shrunk = lambda own, all_: (own * F.col("n") + all_ * LEAST_TEXTS) / (F.col("n") + LEAST_TEXTS)
    medians = x.filter("__lang is not null").groupBy("__lang").agg(middle().alias("m"), F.count("*").alias("n"))
    medians = medians.select("__lang", "n", shrunk(F.col("m"), of_all).alias("__mid"))
    few = medians.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    own = x.join(F.broadcast(medians) if few else medians, "__lang").groupBy("__lang", "__mid", "n").agg((high(F.col("__mid")) + MARGIN).alias("h"))
    return own.select("__lang", "__mid", shrunk(F.col("h"), whole).alias("__limit")), (of_all, whole)


def judged(scored: DataFrame, held_out: Column, lang: str = "lang") -> DataFrame:
    """``scored`` with ``rejected``: no perplexity, or one beyond its language's limit."""
    own, (mid, limit) = limits(scored, held_out, lang)
    few = own.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    joined = scored.join(F.broadcast(own) if few else own, F.col(lang) == F.col("__lang"), "left")
    log = drawn(F.ln("perplexity"), F.col("n_words"), F.coalesce("__mid", F.lit(mid).cast("double")))
    beyond = F.coalesce(log > F.coalesce("__limit", F.lit(limit).cast("double")), F.lit(False))
    return joined.withColumn("rejected", F.col("perplexity").isNull() | beyond).drop("__lang", "__mid", "__limit")


def marked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``trusted`` (good and not toxic by ``labels``) and ``held_out`` (trusted, but kept from training).

    Labels are few beside texts: up to ``BROADCAST_IDS`` trusted ids are
    broadcast, more are joined by a shuffle.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("bigint").alias("__id")).distinct()
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(good) if few else good, F.col(doc_id) == F.col("__id"), "left")
    trusted = F.col("__id").isNotNull()
    held = trusted & (F.pmod(F.xxhash64(doc_id, F.lit("held out")), F.lit(HELD_OUT)) == 0)
    return joined.select(*(docs[c] for c in docs.columns if c not in ("trusted", "held_out")), trusted.alias("trusted"), held.alias("held_out"))


def classify(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``perplexity``, ``n_words``, ``trusted``, ``held_out`` and ``rejected``, read back from the shared folder.

    ``keep_text``: whether the text stays among the columns.
    """
    model = train(marked(docs, labels, doc_id).filter("trusted and not held_out"), text)
    scored = score(docs, model, text=text)
    for folder in model.folders:  # what the blocks asked for has been written out
        discard(docs.sparkSession, folder)
    return judged(marked(cut(scored if keep_text else scored.drop(text)), labels, doc_id), F.col("held_out"), lang)
