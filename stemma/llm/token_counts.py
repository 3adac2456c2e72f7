"""Token counts by Viterbi over a unigram vocabulary, without making the tokens.

A vocabulary is a SentencePiece model's table of pieces and scores, read as a
unigram model.  Aho-Corasick enumerates the pieces that end at each character,
and dynamic programming carries, for each place, the best score and its number
of pieces alone.  The tokenizer's rules hold: a character that no one-character
piece covers may be an unknown, ``PENALTY`` below the least score, which counts
as its UTF-8 bytes; of equal scores the path whose last piece begins first wins;
blanks become the mark ``U+2581``, one of which is put before a text.

No piece joins a mark to what stands before it, unless it is marks alone.  So a
text falls into words that begin with a run of marks, which share no piece; each
distinct word is solved once in a worker, and a text's numbers are sums.  Sums
here are exact; a library that adds up scores in single precision along a whole
text can decide near-ties of very long texts in another way.

Edge cases: null and empty texts have no tokens and score 0; repeated rows are
counted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ._common import ready, slices

MARK = "▁"
PENALTY = 10.0
#: Words whose result a Python worker remembers.
CACHE_WORDS = 400_000


class Counter:
    """Best score and token count of words, by a SentencePiece model's pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: self.model.IsControl(i) or self.model.IsUnknown(i) or self.model.IsByte(i) or self.model.IsUnused(i)
        pieces = {self.model.IdToPiece(i): self.model.GetScore(i) for i in range(len(self.model)) if not special(i)}
        self.bytes = any(self.model.IsByte(i) for i in range(len(self.model)))
        self.unknown = min(pieces.values()) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # Words may be solved apart only if no piece reaches over the place between two.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.apart else re.compile("(?s).+")
        self.known: dict[str, tuple[float, int]] = {}

    def solve(self, word: str) -> tuple[float, int]:
        """Score and count of the best path through ``word``.

        Matches arrive by their end.  At each end the candidates are compared
        from the first beginning on and only a greater score replaces, as in the
        tokenizer; the unknown stands in where no one-character piece does.
        """
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            ends[last + 1].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = -np.inf, 0, False
            for size, score in sorted(ends[end], reverse=True):
                single |= size == 1
                if best[end - size] + score > top:
                    top, pieces = best[end - size] + score, count[end - size] + 1
            if not single and best[end - 1] + self.unknown > top:
                top = best[end - 1] + self.unknown
                pieces = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else 1)
            best[end], count[end] = top, pieces
        return best[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, score, pieces = self.known, 0.0, 0
        for w in self.words.findall(self.model.Normalize(text)):
            x = known.get(w)
            if x is None:
                x = known[w] = self.solve(w)
            score += x[0]
            pieces += x[1]
        return score, pieces


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``best_score``; columns of these names are replaced."""
    ready(docs.sparkSession)
    new = StructType.fromDDL("n_tokens bigint, best_score double")
    kept = docs.drop(*new.names)

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            found = [c.count(t) for part in slices([b.select([text])], text) for t in part[text]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                names=[*b.schema.names, *new.names],
            )

    return kept.mapInArrow(run, StructType([*kept.schema, *new]))
