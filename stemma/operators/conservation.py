"""Alignments as rows (gene, label, species, col, ch), Henikoff weights, and per-column conservation.

Rows of one gene are aligned at the left; what a row lacks at its end counts as
gaps and is never written out, so that data grow with the letters alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import BLOCK, codes_of, per_block, repeated
from .composition import AS_ALIGNED, LETTERS
from .lineage import written

GAP = "-"
#: Pieces of rows that meet one copy of a block's shares.
PIECES = 2_048


def aligned(docs: DataFrame) -> DataFrame:
    """(gene, label, species, row): whole texts as aligned rows, four rare letters as gaps."""
    row = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, AS_ALIGNED)
    return docs.select(F.col("source").alias("gene"), F.col("doc_id").alias("label"), F.col("lang").alias("species"), row.alias("row"))


def columns(rows: DataFrame) -> DataFrame:
    """One row for each letter or gap that was written: col counts from 1."""
    each = F.posexplode(F.split("row", "")).alias("at", "ch")
    return rows.filter(F.length("row") > 0).select("gene", "label", "species", each).select("gene", "label", "species", (F.col("at") + 1).alias("col"), "ch")


def _fields(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def counted(rows: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """(by, col, ch, n, w): how many rows have a letter or written gap in a column, and the sum of their ``weight`` (null: none).

    What is shuffled are blocks of letters or their counts, never a row for each
    letter.  Null rows count as empty ones.
    """

    def finish(group: tuple, at: int, found: dict) -> pa.RecordBatch:
        letters, n, w = found[()].arrays()
        i, col = np.nonzero(n)
        values = pa.array(n[i, col]), pa.array(np.zeros(len(i)) if w is None else w[i, col])
        cells = pa.array(at * BLOCK + col + 1), pa.array(np.array(letters, object)[i], pa.string())
        return pa.RecordBatch.from_arrays([*repeated(group, len(i)), *cells, *values], names=[*by, "col", "ch", "n", "w"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "col int, ch string, n bigint, w double"])
    out = per_block(rows, list(by), [], finish, schema, weight=weight, size=BLOCK)
    return out if weight else out.withColumn("w", F.col("n").cast("double"))


def _shares(rows: DataFrame) -> DataFrame:
    """(gene, block, letters, share, tail, gap, parts, after, cols): a row's share by its letter in each column of a block.

    ``tail`` is what a row gets that ends before a column, for the columns of the block
    from there on, and ``after`` for all later blocks; ``cols`` is the gene's number of
    columns, ``parts`` as how many groups the block's rows are met.
    """

    def finish(group: tuple, at: int, found: dict) -> pa.RecordBatch:
        letters, n, _ = found[()].arrays()
        return pa.RecordBatch.from_arrays([*repeated(group, 1), pa.array([at]), pa.array(["".join(letters)]), pa.array([n.tobytes()], pa.binary())], names=["gene", "block", "letters", "n"])

    def shared(batches):
        for b in batches:
            for i in range(b.num_rows):
                letters, rows = b.column("letters")[i].as_py(), b.column("rows")[i].as_py()
                n = np.frombuffer(b.column("n")[i].as_buffer(), np.int64).reshape(-1, BLOCK)
                present, gaps = n.sum(axis=0), n[letters.index(GAP)] if GAP in letters else np.zeros(BLOCK, np.int64)
                all_gaps = gaps + rows - present
                k = (n > 0).sum(axis=0) + ((gaps == 0) & (present < rows))
                of = np.stack([all_gaps if c == GAP else x for c, x in zip(letters, n, strict=True)])
                share = np.divide(1.0, k * of, out=np.zeros(n.shape), where=n > 0)
                gap = np.divide(1.0, k * all_gaps, out=np.zeros(BLOCK), where=(present > 0) & (all_gaps > 0))
                tail = np.cumsum(gap[::-1])[::-1]
                made = [share.tobytes(), tail.tobytes(), float(tail[0]), -(-int(rows if b.column("block")[i].as_py() == 0 else present[0]) // PIECES), int(np.count_nonzero(present))]
                some = b.slice(i, 1).select(["gene", "block", "letters"])
                arrays = [pa.array([x], t) for x, t in zip(made, (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, *arrays], names=[*some.schema.names, "share", "tail", "gap", "parts", "n_cols"])

    kind = f"gene {rows.schema['gene'].dataType.simpleString()}, block int, letters string, "
    size = rows.groupBy("gene").agg(F.count("*").alias("rows"))
    # Few rows, which are written so that a task has one Python worker and not two.
    blocks = written(per_block(rows, ["gene"], [], finish, kind + "n binary", size=BLOCK)).join(size, "gene")
    later = Window.partitionBy("gene").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.mapInArrow(shared, kind + "share binary, tail binary, gap double, parts bigint, n_cols bigint")
    of_gene = {"after": F.coalesce(F.sum("gap").over(later), F.lit(0.0)), "cols": F.sum("n_cols").over(Window.partitionBy("gene"))}
    return written(found.withColumns(of_gene).drop("n_cols", "gap"))


def _looked_up(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """(gene, label, raw, cols): the sum of a row's shares, those behind its end too, and its gene's number of columns.

    Rows are cut into blocks of columns, which meet the block's shares; a block of
    a gene with many rows is met in as many parts as its rows need.
    """

    def cut(b: pa.RecordBatch):
        """Pieces of rows; the one where a row ends may be empty."""
        of, block, parts, last = [], [], [], []
        for i, row in enumerate(b.column("row")):
            text = row.as_py()
            n = len(text or "") // BLOCK + 1
            of += [i] * n
            block += range(n)
            parts += [(text or "")[at * BLOCK : (at + 1) * BLOCK] for at in range(n)]
            last += [False] * (n - 1) + [text is not None]
        at = pa.array(of, pa.int64())
        arrays = [b.column("gene").take(at), b.column("label").take(at), pa.array(block, pa.int32()), pa.array(parts, pa.string()), pa.array(last)]
        return pa.RecordBatch.from_arrays(arrays, names=["gene", "label", "block", "piece", "last"])

    def pieces_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                yield cut(b.slice(at, 1_000))

    def meet(pieces: pa.Table, shares: pa.Table) -> pa.Table:
        own, tails, cols = [], [], None
        if shares.num_rows:
            of = shares.select(["letters", "share", "tail", "after", "cols"]).to_pylist()[0]
            place = np.full(max(map(ord, of["letters"])) + 1, -1)
            place[[ord(c) for c in of["letters"]]] = range(len(of["letters"]))
            table, tail, cols = np.frombuffer(of["share"]).reshape(-1, BLOCK), np.append(np.frombuffer(of["tail"]), 0.0) + of["after"], of["cols"]
        for piece, last in zip(pieces.column("piece"), pieces.column("last").to_pylist(), strict=True):
            text = piece.as_py()
            own.append(float(table[place[codes_of(text)], np.arange(len(text))].sum()) if text else 0.0)
            tails.append((float(tail[len(text)]) if cols else 0.0) if last else None)
        found = pieces.select(["gene", "label"]).append_column("own", pa.array(own, pa.float64())).append_column("tail", pa.array(tails, pa.float64()))
        return found.append_column("cols", pa.array([cols] * len(own), pa.int64()))

    kinds = _fields(rows, "gene", "label")
    pieces = rows.select("gene", "label", "row").mapInArrow(pieces_of, kinds + ", block int, piece string, last boolean")
    many = shares.filter("parts > 1").select("gene", "block", "parts")
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    left = pieces.join(many, ["gene", "block"], "left").withColumn("part", F.pmod(F.xxhash64("label"), parts)).drop("parts")
    right = shares.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("parts", F.lit(1).cast("bigint")) - 1))).drop("parts")
    key = ["gene", "block", "part"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, kinds + ", own double, tail double, cols bigint")
    # A key's rows each have all its letters' shares, and what lies behind their own end.
    ends = F.when(F.count("tail") > 0, F.collect_list("tail")).otherwise(F.array(F.lit(0.0)))
    per = met.groupBy("gene", "label").agg(F.sum("own").alias("own"), ends.alias("ends"), F.max("cols").alias("cols"))
    return per.select("gene", "label", "own", "cols", F.explode("ends").alias("tail")).select("gene", "label", (F.col("own") + F.col("tail")).alias("raw"), "cols")


def henikoff_weights(rows: DataFrame) -> DataFrame:
    """(gene, label, weight): position-based weights that add up to 1 in a gene; a gap is a letter like others.

    In each column a row gets 1 / (letters * rows with its letter).  Behind a row's
    end its letter is the gap, whose shares are summed from the gene's last column
    backwards, once for each column and not for each row.
    """
    # A column's shares add up to 1, so a gene's add up to its number of columns.
    return _looked_up(rows, _shares(rows)).select("gene", "label", (F.col("raw") / F.nullif("cols", F.lit(0))).alias("weight"))


def _weighted(rows: DataFrame, finish: Callable[[list[str], np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]], kinds: str) -> DataFrame:
    """(gene, col, ...) of letters that aren't gaps, weighted by ``henikoff_weights``.

    ``finish`` makes columns, from 0, and further fields, as ``kinds`` has them, of a
    block's letters, their counts and their sums of weights.
    """

    def of_block(group: tuple, at: int, found: dict) -> pa.RecordBatch | None:
        letters, n, w = found[()].arrays()
        solid = [i for i, c in enumerate(letters) if c != GAP]
        if not solid:
            return None
        col, values = finish([letters[i] for i in solid], n[solid], w[solid])
        return pa.RecordBatch.from_arrays([*repeated(group, len(col)), pa.array(at * BLOCK + col + 1), *values], names=names)

    schema = f"{_fields(rows, 'gene')}, col int, {kinds}"
    names = StructType.fromDDL(schema).fieldNames()
    own = rows.join(henikoff_weights(rows), ["gene", "label"])
    return per_block(own, ["gene"], [], of_block, schema, weight="weight", size=BLOCK)


def conservation(rows: DataFrame, *, letters: int = 4, most_gaps: float = 0.5) -> DataFrame:
    """Per column: gap_fraction, consensus, and, where gaps are few enough, weighted entropy (bits) and conservation."""

    def summed(letters: list[str], n: np.ndarray, w: np.ndarray):
        present = n.sum(axis=0)
        col = np.flatnonzero(present)
        n, w = n[:, col], w[:, col]
        wlogw = (w * np.log2(w, out=np.zeros(w.shape), where=w > 0)).sum(axis=0)
        best = np.array(letters, object)[n.argmax(axis=0)]  # the least letter of equal ones
        return col, [pa.array(present[col]), pa.array(w.sum(axis=0)), pa.array(wlogw), pa.array(best, pa.string())]

    size = rows.groupBy("gene").agg(F.count("*").alias("rows"))
    total = _weighted(rows, summed, "present bigint, sum_w double, sum_wlogw double, consensus string")
    # Entropy of w / sum_w, without another pass: log2(sum_w) - sum(w log2 w) / sum_w.
    h = F.log2("sum_w") - F.col("sum_wlogw") / F.nullif("sum_w", F.lit(0.0))
    h = F.when(h < 1e-9, 0.0).otherwise(h)
    out = total.join(size, "gene").withColumn("gap_fraction", 1 - F.col("present") / F.col("rows"))
    scored = F.col("gap_fraction") <= most_gaps
    return out.select(
        "gene",
        "col",
        "gap_fraction",
        "consensus",
        F.when(scored, h).alias("entropy"),
        F.when(scored, 1 - h / math.log2(letters)).alias("conservation"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """(gene, col, ref_position, ref_letter) along each gene's first label; position null where it has a gap."""
    first = rows.groupBy("gene").agg(F.min_by("row", "label").alias("row"), F.min("label").alias("label"), F.lit("").alias("species"))
    own = columns(first.select("gene", "label", "species", "row"))
    along = Window.partitionBy("gene").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    solid = F.col("ch") != GAP
    return own.select("gene", "col", F.when(solid, F.sum(solid.cast("int")).over(along)).alias("ref_position"), F.when(solid, F.col("ch")).otherwise("").alias("ref_letter"))


def rolling(rows: DataFrame, by: list[str], order: list[str], value: str, size: int, least: int, *, centred: bool = False) -> DataFrame:
    """``rows`` with ``rolling``: the mean of ``size`` rows that end at, or lie around, each; null with fewer than ``least`` values."""
    window = Window.partitionBy(*by).orderBy(*order)
    window = window.rowsBetween(-(size // 2), (size - 1) // 2) if centred else window.rowsBetween(1 - size, 0)
    return rows.withColumn("rolling", F.when(F.count(value).over(window) >= least, F.avg(value).over(window)))


def region_window(length: int) -> int:
    return min(30, max(10, length // 10))


def extreme_windows(scores: DataFrame, *, top: int = 3, size: int | None = None, share: float = 0.7) -> DataFrame:
    """Per gene the ``top`` most and least conserved windows without overlap, the conserved ones taken first.

    A gene's scores, a row for each column, are one group: as long as its longest
    row, not as its number of rows.  Ties go to the earlier window.  ``size``: that
    of ``region_window`` for the gene's columns where none is given.
    """
    wanted = size

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        size = wanted or region_window(len(group))
        g = group.dropna(subset=["conservation"]).sort_values("col")
        means = g["conservation"].rolling(size, min_periods=max(1, int(share * size))).mean()
        table = pd.DataFrame({"end": g["col"].to_numpy(), "mean": means.to_numpy()}).dropna()
        used: list[int] = []
        out = []
        for kind, ascending in (("conserved", False), ("variable", True)):
            n = 0
            for r in table.sort_values(["mean", "end"], ascending=[ascending, True]).itertuples():
                if n == top:
                    break
                start = r.end - size + 1
                if start < 1 or any(abs(r.end - t) < size for t in used):
                    continue
                used.append(r.end)
                n += 1
                out.append((group["gene"].iloc[0], kind, n, int(start), int(r.end), float(r.mean)))
        return pd.DataFrame(out, columns=["gene", "kind", "rank", "start", "end", "mean_conservation"])

    return scores.select("gene", "col", "conservation").groupBy("gene").applyInPandas(
        pick, "gene string, kind string, rank int, start bigint, end bigint, mean_conservation double"
    )


def motifs(scores: DataFrame, *, width: int = 7, top: int = 6) -> DataFrame:
    """(gene, rank, start, end, mean_conservation): the best full windows of a gene that begin ``width`` columns apart or more.

    A gene's scores are one group, as long as its longest row; ties go to the earlier window.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("col")
        means = g["conservation"].rolling(width, min_periods=width).mean().round(9)
        table = pd.DataFrame({"end": g["col"].to_numpy(), "mean": means.to_numpy()}).dropna().sort_values(["mean", "end"], ascending=[False, True])
        out: list[tuple] = []
        for r in table.itertuples():
            if all(abs(r.end - x[3]) >= width for x in out):
                out.append((group["gene"].iloc[0], len(out) + 1, int(r.end) - width + 1, int(r.end), float(r.mean)))
            if len(out) == top:
                break
        return pd.DataFrame(out, columns=["gene", "rank", "start", "end", "mean_conservation"])

    return scores.select("gene", "col", "conservation").groupBy("gene").applyInPandas(pick, "gene string, rank int, start bigint, end bigint, mean_conservation double")


def verified_sites(seqs: DataFrame, sites: DataFrame, *, longest: int = 32, around: int = 5) -> DataFrame:
    """Each of ``sites`` (position, expected, motif, pattern) in each of ``seqs`` (label, seq) that is long enough.

    A site is in its motif if a match of the pattern begins before it and ends at it
    or behind, wherever matches begin, overlapping ones too; a match is ``longest``
    letters at most.  ``context`` is the site with ``around`` letters on either side.
    Sites are few: each row of ``seqs`` meets all of them.
    """
    known = sites.agg(F.collect_list(F.struct("position", "expected", "motif", "pattern")).alias("sites"))
    each = seqs.join(F.broadcast(known)).select("label", "seq", F.explode("sites").alias("s")).select("label", "seq", "s.*").filter(F.col("position") <= F.length("seq"))
    offsets = F.sequence(F.greatest(F.lit(0), F.col("position") - longest), F.col("position") - 1)
    anchored = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))
    reaches = lambda s: F.coalesce(F.length(F.regexp_substr(F.substring("seq", s + 1, F.lit(longest)), anchored)), F.lit(0)) >= F.col("position") - s
    start = F.greatest(F.lit(1), F.col("position") - around)
    observed = F.substring("seq", F.col("position"), F.lit(1))
    return each.select(
        "label", "position", "motif", "expected", observed.alias("observed"), (observed == F.col("expected")).alias("as_expected"),
        F.exists(offsets, reaches).alias("in_motif"), F.substring("seq", start, F.col("position") + around - start + 1).alias("context"),
    )


def match_states(row: Column, ref: Column) -> Column:
    """For each place of ``row``: 2 where ``ref`` is the same, 1 where it differs, 0 where either has a gap or ``ref`` has ended."""
    both = F.arrays_zip(F.split(row, "").alias("a"), F.split(ref, "").alias("b"))
    state = lambda x: F.when((x["a"] == GAP) | (x["b"] == GAP) | x["b"].isNull() | (x["b"] == ""), 0).when(x["a"] == x["b"], 2).otherwise(1)
    return F.transform(F.slice(both, F.lit(1), F.length(row)), state)


def frequencies(rows: DataFrame) -> DataFrame:
    """(gene, col, ch, freq): weighted letter frequencies of each column without its gaps."""

    def shared(letters: list[str], n: np.ndarray, w: np.ndarray):
        i, col = np.nonzero(n)
        total = w.sum(axis=0)[col]
        freq = np.divide(w[i, col], total, out=np.zeros(len(i)), where=total > 0)
        return col, [pa.array(np.array(letters, object)[i], pa.string()), pa.array(freq, mask=total <= 0)]

    return _weighted(rows, shared, "ch string, freq double")


def information(freq: DataFrame, letters: int = 4) -> DataFrame:
    """(gene, col, bits): log2 of the alphabet's size less the entropy."""
    p = F.col("freq")
    return freq.groupBy("gene", "col").agg((F.lit(math.log2(letters)) + F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("bits"))


def log_odds(freq: DataFrame, letters: int = 4, pseudo: float = 0.01) -> DataFrame:
    """(gene, col, ch, score): log2 of the smoothed frequency over the even one."""
    smooth = (F.col("freq") + pseudo) / (1 + letters * pseudo)
    return freq.select("gene", "col", "ch", F.log2(smooth * letters).alias("score"))
