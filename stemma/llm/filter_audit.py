"""How filters interact: what each removes in every order of the filters.

Five filters judge a text: A, too few words; B, too few distinct words; C, too many
capitals; D, a character of a set; E, the text of a smaller id.  A document's failures
are one mask of five bits, and everything that an order of the filters does follows
from the number of documents with each mask, so that texts are read for the masks
and never for an order.

Duplicates come from a partition refined step by step: documents are split by their
number of code points, then by a hash of their first block, of the second one, and
of the rest.  After each step the documents that are alone in their class are dropped,
so that hashes of later blocks move for fewer and fewer of them.  The full texts of
those left over are compared, copies within a task being merged before texts move,
and all but the smallest id of a text are marked.

Edge cases: a null text is an empty one; null and empty sources are one part, named
by the empty string; rows that repeat an id and text are no duplicates of each other;
a null id is neither a duplicate nor the first of any, and has no label; of several
labels of one id each counts as given if any row gives it; very long texts are hashed
and compared whole; other columns are not read; an empty table returns no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, Scratch, cut, join_by

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
#: Where the blocks of a text end, in code points; the last block is what is left.
BLOCKS = (256, 4096)
#: The classes after each step: what a document must share with another to stay.
STEPS = [["size", *(f"h{i}" for i in range(k))] for k in range(len(BLOCKS) + 2)]


def alone(text: Column) -> Column:
    """Bits 0 to 3: what a text fails on its own account."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    found = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    # One struct in an array, so that the words are found once.
    return F.transform(
        F.array(found),
        lambda x: F.when(x["n"] < MIN_WORDS, 1).otherwise(0)
        + F.when(100 * x["d"].cast("bigint") < DISTINCT_PERCENT * x["n"].cast("bigint"), 2).otherwise(0)
        + F.when(100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.length(text).cast("bigint"), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0),
    )[0]


def blocks(text: Column) -> list[Column]:
    """The hashes of a text's successive blocks: h0, h1, ..."""
    starts, ends = (0, *BLOCKS), (*BLOCKS, None)
    return [F.xxhash64(F.substring(text, a + 1, (2**31 - 1 if z is None else z) - a)).alias(f"h{i}") for i, (a, z) in enumerate(zip(starts, ends, strict=True))]


def refined(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``rows`` (size, h0, h1, ...) that share all of it with another row, found step by step."""
    for keys in STEPS:
        # Hashes are never null, so that equality holds for all of the key.
        more = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
        rows = rows.join(more, keys, "left_semi")
        if len(keys) > 1:  # lengths alone drop little, and are not worth a table
            rows = scratch.cut(rows)
    return rows


def first_ids(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The smallest id, ``first``, of each text within ``classes``, with the class and the number of its rows.

    Up to ``BROADCAST_KEYS`` classes are sent to the texts; of more, the texts are shuffled once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.filter("doc_id is not null").select("doc_id", text.alias("text"), F.length(text).alias("size"), *blocks(text))
    wanted = classes.select(*STEPS[-1]).distinct()
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    left = keyed.join(F.broadcast(wanted) if few else wanted, STEPS[-1], "left_semi")
    return left.groupBy(*STEPS[-1], "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def copies(docs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and class of the documents whose text a smaller id has."""
    classes = refined(own.filter("doc_id is not null").select("doc_id", *STEPS[-1]), scratch)
    texts = scratch.cut(first_ids(docs, classes))
    per_class = texts.groupBy(*STEPS[-1]).agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    key, whole = F.xxhash64(*STEPS[-1]).alias("key"), F.struct(*STEPS[-1])
    # Classes of one text, which all but collisions are, mark by class; those of more texts by the texts themselves.
    single = per_class.filter("texts = 1 and n > 1").select(key, whole.alias("of"), "first", "n")
    same = join_by(classes.select(key, whole.alias("class"), "doc_id"), single, "key").filter(F.col("class") == F.col("of"))
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = per_class.filter("texts > 1").select(*STEPS[-1])
    by_text = docs.select("doc_id", text.alias("text"), F.length(text).alias("size"), *blocks(text)).join(F.broadcast(mixed), STEPS[-1], "left_semi")
    apart = by_text.join(texts.select(*STEPS[-1], "text", "first"), [*STEPS[-1], "text"]).select("doc_id", whole.alias("class"), "first")
    found = same.select("doc_id", "class", "first").unionByName(apart) if mixed.limit(1).count() else same.select("doc_id", "class", "first")
    return found.filter(F.col("doc_id") > F.col("first")).select("doc_id", "class").distinct()


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part and mask of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = scratch.cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), alone(text).alias("own"), F.length(text).alias("size"), *blocks(text)))
    marked = copies(docs, own, scratch).select(F.col("doc_id").alias("id"), F.col("class").alias("of"), F.lit(16).alias("copy"))
    named = own.filter("doc_id is not null").withColumn("class", F.struct(*STEPS[-1]))
    found = named.join(marked, (F.col("doc_id") == F.col("id")) & (F.col("class") == F.col("of")), "left")
    judged = found.select("doc_id", "part", (F.col("own") + F.coalesce("copy", F.lit(0))).alias("mask"))
    return judged.unionByName(own.filter("doc_id is null").select("doc_id", "part", F.col("own").alias("mask")))


def orders() -> Column:
    """All orders of the filters, by letters."""
    return F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))


def interactions(counts: DataFrame) -> DataFrame:
    """Every order and step of each part of ``counts`` (part, mask, n, good, toxic), from the counts of its masks."""
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = per_part.withColumn("filter_order", F.explode(orders())).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", i, 1)) - ord(FILTERS[0]))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda a, i: a + F.when(i == 0, 0).otherwise(bit(i)))
    coded = each.withColumns({"bit": bit(F.col("step")), "before": before})

    def total(of: str, when) -> Column:
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda a, m: a + F.when(when(m["mask"]), m[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # In the orders a document's removal falls to each filter that it fails equally often.
    share = F.aggregate(
        "masks",
        F.lit(0).cast("bigint"),
        lambda a, m: a + F.when(fails(m["mask"]), m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("bigint")).otherwise(0),
    )
    return coded.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of documents: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    scratch = Scratch(docs.sparkSession)
    judged = scratch.cut(masks(docs, scratch))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    zero = {"good": 0, "toxic": 0}
    labelled = judged.join(known, "doc_id").fillna(zero).groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = cut(judged.groupBy("part", "mask").agg(F.count("*").alias("n")).join(labelled, ["part", "mask"], "left").fillna(zero))
    scratch.clear()
    return interactions(counts)
