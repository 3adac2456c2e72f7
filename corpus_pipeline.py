"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``: they drop rows or change texts.

Edge cases: null and empty texts have no perplexity, so the first stage drops
them; repeated rows of one doc_id pass or go together; extra columns of ``docs``
are kept; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import byte_bpe, decontaminate, near_duplicates, quality_model, secrets
from stemma.llm._common import cut, table
from stemma.llm.queries import BYTE_RANKS, PATTERN


#: Columns that stages read; others travel in one column, so that none clashes with what an operator adds.
NAMED = ("doc_id", "text", "lang")


def apart(docs: DataFrame) -> DataFrame:
    rest = F.struct(F.lit(True).alias("__kept"), *(c for c in docs.columns if c not in NAMED))
    return docs.select(*(c for c in docs.columns if c in NAMED), rest.alias("__rest"))


def together(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(c) if c in NAMED else F.col("__rest")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    judged = quality_model.classify(apart(docs), table(spark, sf_dir, "labels"))
    return together(judged.filter(~F.col("rejected")), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least doc_id, of each class of near duplicates: five words, 0.8."""
    found = near_duplicates.near_duplicates(docs, n=5, percent=80)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    same = (F.col("doc_id") == F.col("gone")) & (near_duplicates.text_hash() == F.col("text_hash"))
    return together(apart(docs).join(gone.hint("shuffle_hash"), same, "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = decontaminate.hits(apart(docs), table(spark, sf_dir, "benchmark"))
    return together(found.filter("n_hit = 0"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; ``n_chars`` follows."""
    found = secrets.join_back(apart(docs), secrets.scan(docs))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("findings")))
    whole = together(clean, docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("findings") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        whole = together(clean.withColumn("__rest", F.col("__rest").withField("n_chars", changed.otherwise(F.col("__rest.n_chars")))), docs)
    return whole


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids."""
    return byte_bpe.encode_decode(docs, BYTE_RANKS, PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", byte_level_bpe),
]

#: The first stage's model can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
