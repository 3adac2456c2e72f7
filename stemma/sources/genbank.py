"""GenBank flat files as feature rows: one row a CDS or rRNA, with its sequence cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "accession string, type string, locus_tag string, old_locus_tag string, protein_id string, gene_name string, product string, "
    "start bigint, end bigint, strand int, pseudo boolean, nt string, aa string"
)
METADATA = "accession string, title string, length bigint, gc double"
SLICE = "accession string, gene string, value string"
#: A record's end, which also parts the records of one file.
RECORD_END = "\n//"
_COMPLEMENT = str.maketrans("ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")
_SPAN = re.compile(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?")


def located(location: str, whole: str) -> tuple[int, int, int, str]:
    """Start (from 0), end, strand and sequence of a location; parts of a join are read in the order of the strand."""
    text, strand = location.replace(" ", ""), 1
    if text.startswith("complement("):
        text, strand = text[11:-1], -1
    spans, pieces = [], []
    for part in re.split(r",(?![^(]*\))", re.sub(r"^(join|order)\((.*)\)$", r"\2", text)):
        inner = part.startswith("complement(")
        m = _SPAN.search(part)
        if not m:
            continue
        a, z = int(m[1]) - 1, int(m[2] or m[1])
        piece = whole[a:z]
        pieces.append(piece.translate(_COMPLEMENT)[::-1] if inner else piece)
        spans.append((a, z, inner))
    if not spans:
        return 0, 0, strand, ""
    nt = "".join(pieces)
    if strand == -1:
        nt = nt.translate(_COMPLEMENT)[::-1]
    elif all(s[2] for s in spans):
        strand = -1
    return min(s[0] for s in spans), max(s[1] for s in spans), strand, nt.upper()


def _qualified(lines: list[str]) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(key, location, qualifiers): of repeated qualifiers the first counts."""
    entries: list[tuple[str, list[str]]] = []
    for line in lines:
        if line[5:6].strip():
            entries.append((line[5:21].strip(), [line[21:].strip()]))
        elif entries:
            entries[-1][1].append(line[21:].strip())
    for key, body in entries:
        parts = [[]]
        for x in body:
            if x.startswith("/"):
                parts.append([])
            parts[-1].append(x)
        found: dict[str, str] = {}
        for p in parts[1:]:
            name, _, value = " ".join(p)[1:].partition("=")
            value = value.strip('"')
            found.setdefault(name, value.replace(" ", "") if name == "translation" else value)
        yield key, "".join(parts[0]), found


def features(record: str) -> Iterator[tuple]:
    """The rows of one record's CDS and rRNA features."""
    head, _, rest = record.partition("\nFEATURES")
    table, _, origin = rest.partition("\nORIGIN")
    accession = next((x.split()[1] for x in head.splitlines() if x.startswith("ACCESSION") and len(x.split()) > 1), "")
    whole = re.sub(r"[^A-Za-z]", "", origin.partition("\n")[2])
    for key, location, q in _qualified(table.splitlines()[1:]):
        if key in ("CDS", "rRNA"):
            start, end, strand, nt = located(location, whole)
            names = (q.get(n, "") for n in ("locus_tag", "old_locus_tag", "protein_id", "gene", "product"))
            yield (accession, key, *names, start, end, strand, "pseudo" in q or "pseudogene" in q, nt, q.get("translation", ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of all records under ``path``; files are split at record ends, so that records are read in parallel."""
    records = spark.read.text(path, lineSep=RECORD_END)
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for t in b.column("value").to_pylist() if t and "FEATURES" in t for r in features(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    out = records.mapInArrow(run, FEATURES.replace("strand int", "strand bigint"))
    return out.withColumn("strand", out["strand"].cast("int"))


def whole_of(record: str) -> tuple[str, str, str]:
    """A record's accession, title and sequence."""
    head, _, rest = record.partition("\nFEATURES")
    accession = next((x.split()[1] for x in head.splitlines() if x.startswith("ACCESSION") and len(x.split()) > 1), "")
    title = re.search(r"^DEFINITION +((?:.|\n {12})*)", head, re.M)
    seq = re.sub(r"[^A-Za-z]", "", rest.partition("\nORIGIN")[2].partition("\n")[2]).upper()
    return accession, re.sub(r"\s+", " ", title[1]).strip().rstrip(".") if title else "", seq


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: accession, title, length and share of G and C (null without A, C, G and T)."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("value").to_pylist():
                if t and "FEATURES" in t:
                    accession, title, seq = whole_of(t)
                    gc, known = (sum(map(seq.count, letters)) for letters in ("GC", "ACGT"))
                    rows.append((accession, title, len(seq), round(gc / known, 4) if known else None))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["accession", "title", "length", "gc"])

    return spark.read.text(path, lineSep=RECORD_END).mapInArrow(run, METADATA)


def coding(rows: DataFrame) -> DataFrame:
    """Features that are translated and no pseudogenes."""
    return rows.filter((F.col("type") == "CDS") & (F.col("aa") != "") & ~F.col("pseudo"))


def ribosomal(rows: DataFrame) -> DataFrame:
    """Coding features whose product is a protein of a ribosome's subunit."""
    return coding(rows).filter(F.col("product").rlike("^(30S|50S) ribosomal protein"))


def cut_out(gene: str, accession: str, start: int, end: int, seq: str) -> str:
    """A record of ``seq`` from ``start`` (from 0) to ``end`` alone."""
    part = seq[start:end].lower()
    lines = [f"{i + 1:>9} " + " ".join(part[j : j + 10] for j in range(i, min(i + 60, len(part)), 10)) for i in range(0, len(part), 60)]
    return "\n".join([
        f"LOCUS       {gene[:16]:<16} {len(part):>11} bp    DNA     linear   UNK",
        f"DEFINITION  {gene} of {accession}.",
        f"ACCESSION   {accession}:{start + 1}-{end}",
        "FEATURES             Location/Qualifiers",
        f"     gene            1..{len(part)}",
        f'                     /gene="{gene}"',
        "ORIGIN",
        *lines,
        "//",
    ])


def slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(accession, gene, value): a record for each row (accession, gene, start, end) of ``wanted``; accessions that ``path`` lacks give none.

    A record's places travel to it as one list, so that its sequence isn't repeated.
    """

    def named(batches):
        for b in batches:
            found = [whole_of(t) for t in b.column("value").to_pylist() if t and "FEATURES" in t]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 2)], names=["accession", "seq"])

    def run(batches):
        for b in batches:
            for accession, seq, places in zip(*(b.column(c).to_pylist() for c in ("accession", "seq", "places")), strict=True):
                rows = [(accession, p["gene"], cut_out(p["gene"], accession, p["start"], p["end"], seq)) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["accession", "gene", "value"])

    wholes = spark.read.text(path, lineSep=RECORD_END).mapInArrow(named, "accession string, seq string")
    places = wanted.dropna(subset=["gene", "start", "end"]).groupBy("accession").agg(F.collect_list(F.struct("gene", "start", "end")).alias("places"))
    return wholes.join(places, "accession").mapInArrow(run, SLICE)


def write_slices(rows: DataFrame, path: str) -> None:
    """Records as text, in a folder of its own for each gene."""
    rows.select("gene", "value").write.mode("overwrite").partitionBy("gene").text(path)
