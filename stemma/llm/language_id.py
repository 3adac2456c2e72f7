"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone.
A trigram's vector binds its letters' vectors by multiplication after rotating
each by its place; a text's vector, and a language's prototype, bundles the
vectors of all its trigrams by addition.  A text gets the language whose
prototype has the greatest cosine with it.

Bundling is linear, so a prototype is summed up from partial bundles of each
partition, and a text's products with the prototypes are sums over its trigrams.
The text's own length divides all its cosines alike; the score is the best
cosine's share of the positive ones, in which it cancels.

Edge cases: a null text, one without letters, or one met before any language was
learned is ``und`` with score 0; equal cosines go to the first language in
alphabetical order; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import ready, slices

DIMENSIONS = 1024
#: Prototypes are collected and broadcast; more languages than this are refused.
MAX_LANGUAGES = 4096
_SHIFT = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(50_000)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1 and -1 at random, the same on every machine."""
    return (np.random.Generator(np.random.Philox(key=code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all the texts as numbers, and how many each text has.

    A run of characters that aren't letters counts as one blank, which also
    stands before and behind a text.
    """
    joined = "\0".join(["", *((t or "").lower() for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = codes == 0
    if int(ends.sum()) != len(texts) + 1:  # a text has the separator itself
        return trigrams([(t or "").replace("\0", " ") for t in texts])
    letters = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    keep = (letters != 0) | ends | (np.concatenate([[1], letters[:-1]]) != 0)
    # The blank that a text ends in may stand for its separator too, so each separator stays and other blanks next to one go.
    near = np.concatenate([[False], ends[:-1]]) | np.concatenate([ends[1:], [False]])
    keep &= ends | ~(near & (letters == 0))
    row = np.cumsum(ends)[keep]
    kept, at_end = letters[keep], ends[keep]
    grams = kept[:-2] << (_SHIFT + _SHIFT) | kept[1:-1] << _SHIFT | kept[2:]
    inner = ~at_end[1:-1] & (grams != 0)
    return grams[inner], np.bincount(row[1:-1][inner] - 1, minlength=len(texts))


def bind(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each trigram: the product of its letters' rotated vectors."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place, shift in enumerate((_SHIFT + _SHIFT, _SHIFT, np.uint64(0))):
        codes, inverse = np.unique(grams >> shift & _MASK, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dimensions), 2 - place) for c in codes]) if len(codes) else np.empty((0, dimensions), np.int8)
        out *= table[inverse]
    return out


def bundle(texts: list[str], labels: list[str], dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The sum of the trigram vectors of each label's texts."""
    grams, sizes = trigrams(texts)
    names = sorted(set(labels))
    if not len(grams):
        return {}
    distinct, inverse = np.unique(grams, return_inverse=True)
    number = {name: i for i, name in enumerate(names)}
    owner = np.repeat([number[x] for x in labels], sizes)
    counts = np.bincount(owner * len(distinct) + inverse, minlength=len(names) * len(distinct)).reshape(len(names), -1)
    total = np.zeros((len(names), dimensions))
    for at in range(0, len(distinct), 16_384):
        total += counts[:, at : at + 16_384].astype(np.float64) @ bind(distinct[at : at + 16_384], dimensions).astype(np.float64)
    return {name: total[i].astype(np.int64) for name, i in number.items()}


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each label, learned from every row with text and label."""
    ready(docs.sparkSession)

    def run(batches):
        partial: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices([b], text):
                for name, v in bundle(part[text], part[label], dimensions).items():
                    partial[name] = partial.get(name, 0) + v
        for name, v in partial.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["label", "v"])

    rows = docs.select(text, label).filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    sums = (
        rows.mapInArrow(run, "label string, v array<bigint>")
        .select("label", F.posexplode("v").alias("d", "x"))
        .groupBy("label", "d")
        .agg(F.sum("x").alias("x"))
        .groupBy("label")
        .agg(F.expr("transform(array_sort(collect_list(struct(d, x))), y -> y.x)").alias("v"))
    )
    found = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    return {r.label: np.array(r.v, np.int64) for r in sorted(found)}


def predict_texts(texts: list[str | None], names: list[str], unit: np.ndarray) -> tuple[list[str], list[float]]:
    """Label and score of each text; ``unit``: a column of length one for each name."""
    grams, sizes = trigrams(texts)
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not len(grams) or not names:
        return labels, scores
    distinct, inverse = np.unique(grams, return_inverse=True)
    products = np.concatenate(
        [bind(distinct[at : at + 16_384], len(unit)).astype(np.float32) @ unit.astype(np.float32) for at in range(0, len(distinct), 16_384)]
    ).astype(np.float64)
    some = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[some]
    sums = np.stack([np.add.reduceat(products[:, k][inverse], starts) for k in range(len(names))], 1)
    best = sums.argmax(1)
    positive = np.maximum(sums, 0)
    top = positive[np.arange(len(some)), best]
    share = np.divide(top, positive.sum(1), out=np.zeros(len(some)), where=top > 0)
    for i, k, s in zip(some.tolist(), best.tolist(), share.tolist(), strict=True):
        labels[i], scores[i] = names[k], min(1.0, s)
    return labels, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    spark = ready(docs.sparkSession)
    names = [n for n in sorted(prototypes) if np.any(prototypes[n])]
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n].astype(float)) for n in names], 1) if names else np.zeros((DIMENSIONS, 0))
    shared = spark.sparkContext.broadcast((names, unit))
    new = StructType.fromDDL("lang_pred string, score double")
    kept = docs.drop(*new.names)

    def run(batches):
        for b in batches:
            labels, scores = [], []
            for part in slices([b.select([text])], text):
                x, y = predict_texts(part[text], *shared.value)
                labels += x
                scores += y
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *new.names])

    return kept.mapInArrow(run, StructType([*kept.schema, *new]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the rows that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
