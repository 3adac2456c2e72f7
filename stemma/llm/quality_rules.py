"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Words are runs of characters other than ASCII white space.  A text first gets
its base counts; one that fails the base limits is rejected outright.  The rest
passes through a cascade of rules.  On a bounded sample each rule's cost (its
seconds) and selectivity (the share that it rejects) are measured, and the rules
run in the order of rejections per second, so that most rejected texts meet one
cheap rule.  The order changes the cost alone: a text is kept if no rule rejects
it, whichever runs first.

Edge cases: null and empty texts have no words, fail the base limits and are
not kept; repeated rows are judged alike; very long texts are judged whole, but
none beyond ``SAMPLE_CHARS`` is in the sample; rules that gain alike run in the
order of their declaration; columns with the names of the results are replaced; an
empty table returns no rows and leaves the order as declared.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import ready, slices

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Documents whose rules are timed to order the cascade, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 100_000
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_ALNUM = bytes(b for b in range(256) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


@dataclass
class Text:
    """A text's bytes and words, and the counts that rules share; each is found when first asked for."""

    raw: bytes
    words: list[bytes]
    base: dict[str, int] = field(default_factory=dict)


def repeat_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside ``n``-word windows that occur twice or more, first occurrences included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    # Prefix doubling gives each window an exact class number: no hash, so no collision.
    classes, length = ids, 1
    while length < n:
        step = min(length, n - length)
        pairs = classes[: len(classes) - step] * (int(classes.max()) + 1) + classes[step:]
        classes = np.unique(pairs, return_inverse=True)[1]
        length += step
    often = np.flatnonzero(np.bincount(classes)[classes] > 1)
    if not len(often):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[often] += 1
    edge[often + n] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> Text:
    raw = (text or "").encode()
    words = raw.split()
    joined = b"".join(words)
    return Text(
        raw,
        words,
        {
            "n_words": len(words),
            "word_chars": len(joined) if joined.isascii() else len(joined.decode()),
            "n_symbols": len(raw.translate(None, _NOT_SYMBOL)),
            "n_dup_lines": duplicate_lines(raw),
            "n_repeat_words": repeat_words(words),
        },
    )


def base_failed(base: dict[str, int]) -> bool:
    return base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"]


def _upper(t: Text) -> bool:
    return 2 * len(t.raw.translate(None, _UPPER)) > len(t.raw.translate(None, _LETTERS))


def _wordless(t: Text) -> bool:
    return 5 * sum(1 for w in t.words if not w.translate(None, _ALNUM)) > 2 * len(t.words)


#: A rule rejects a text; all of them use whole-number arithmetic, so that SQL can say the same.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols_per_word": lambda t: 5 * t.base["n_symbols"] > t.base["n_words"],
    "short_words": lambda t: t.base["word_chars"] < 2 * t.base["n_words"],
    "long_words": lambda t: t.base["word_chars"] > 16 * t.base["n_words"],
    "duplicate_lines": lambda t: t.base["n_dup_lines"] > 2 and 10 * t.base["n_dup_lines"] > 3 * (t.raw.count(b"\n") + 1),
    "upper_case": _upper,
    "words_without_letter": _wordless,
    "digits": lambda t: 5 * len(t.raw.translate(None, _NOT_DIGIT)) > t.base["word_chars"],
}


def order_rules(sample: list[Text], rules: dict[str, Callable[[Text], bool]] = RULES, clock=time.perf_counter) -> list[str]:
    """Rule names, each the one that rejects most per second of what those before it let pass; ties keep the declared order."""
    order, left = [], dict(rules)
    while left:
        gain, verdicts = {}, {}
        for name, rule in left.items():
            began = clock()
            verdicts[name] = [rule(t) for t in sample]
            gain[name] = sum(verdicts[name]) / max(clock() - began, 1e-9)
        best = max(left, key=gain.__getitem__)
        sample = [t for t, rejected in zip(sample, verdicts[best], strict=True) if not rejected]
        order.append(best)
        del left[best]
    return order


def plan_cascade(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules from a random sample of about ``rows`` texts that pass the base limits, read by the driver.

    Each row is drawn on its own, so that none but the drawn texts leaves its task; four times ``rows`` is the most.
    """
    drawn = docs.select(text).filter(F.rand(3) < rows / max(docs.count(), 1)).filter(F.length(text) <= SAMPLE_CHARS).limit(4 * rows)
    sample = [measure(r[0]) for r in drawn.collect()]
    return order_rules([t for t in sample if not base_failed(t.base)])


def apply_rules(docs: DataFrame, *, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``; columns of these names are replaced."""
    ready(docs.sparkSession)
    order = plan_cascade(docs, text) if order is None else order
    new = StructType.fromDDL(FIELDS)
    kept = docs.drop(*new.names)

    def run(batches):
        rules = [RULES[name] for name in order]
        for b in batches:
            rows = {c: [] for c in new.names}
            for part in slices([b.select([text])], text):
                for value in part[text]:
                    t = measure(value)
                    failed = base_failed(t.base)
                    for k, v in t.base.items():
                        rows[k].append(v)
                    rows["base_failed"].append(failed)
                    rows["kept"].append(not failed and not any(rule(t) for rule in rules))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(rows[f.name], pa.bool_() if f.name in ("base_failed", "kept") else pa.int64()) for f in new)],
                names=[*b.schema.names, *new.names],
            )

    return kept.mapInArrow(run, StructType([*kept.schema, *new]))
