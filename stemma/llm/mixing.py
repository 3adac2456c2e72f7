"""Mixing sources to target weights by a splitting tree of block quotas.

A source's documents fall into blocks by a hash of their id and text; its blocks are
permuted by a second hash.  A source's target in words is met by whole passes over
its blocks and by the first blocks of the permutation, the last of which is taken in
part: its documents in hashed order until the words are spent, so that at most one
document a source is cut.  The number of blocks drawn so is the source's quota.

A binary tree splits the quotas of all sources among the output shards: a node of m
blocks, a of which go left, gives its left child a multivariate hypergeometric draw
of its quotas, made source by source from conditional hypergeometric draws.  So each
shard has exactly its number of blocks, each source exactly its quota over all
shards, and the shards are as mixed as a random permutation of all blocks would have
them, while only counts move.  The shards then draw disjoint runs of each source's
permuted blocks, and each shard's documents are shuffled within it.

Only aggregates are counted by source: blocks are at most ``MOST_BLOCKS`` a source,
so that windows over them are bounded, and documents meet their block by (source,
block), however many a source has.  All draws are made of hashes of ``seed``, so
that a rerun agrees.

Edge cases: a null text has no words; documents without words are in the blocks and
take 0; a null source is a source of its own and the last one; rows that repeat an
id and text share a block and are drawn alike, but for the cut document; null ids
are told apart by their texts; names that the operator adds replace columns of
the documents; very long texts are counted whole; an empty table returns no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, cut

WEIGHTS = (5, 2, 1)
#: The mix's share of all words, in percent, and how often a document may be taken at most.
PERCENT, MOST = 150, 2
#: Words of a block, blocks of a source at most, and words of an output shard.
BLOCK_WORDS, MOST_BLOCKS, SHARD_WORDS = 4096, 65_536, 2_000_000
#: Deviations from the mean beyond which a draw's probability is below what a double can tell.
DEVIATIONS = 12
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "draws", "taken")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the number of words and the hash that deals documents to blocks and orders them."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.withColumns({"size": words, "hash": F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")})


def _bucket() -> Column:
    return F.col("hash") % MOST_BLOCKS


def _n_blocks(block_words: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("bigint")


def _block(bucket: Column, n_blocks: str) -> Column:
    return F.floor(bucket * F.col(n_blocks) / MOST_BLOCKS).cast("bigint")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``per_source`` (source, source_size) with ``target``: shares by weight, none above ``most`` times its size.

    Excess is reshared by weight until no target is above its limit.  The sources that
    end at their limit are those with the smallest limit for their weight, so that
    running sums in that order find them at once.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = per_source.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    # What an unlimited source gets for a unit of weight if just the sources before it are limited.
    left = F.lit(percent) * F.sum("source_size").over(every) / 100.0 - F.coalesce(F.sum("limit").over(before), zero)
    of = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    rated = named.withColumn("rate", left / of)
    # The first source whose limit isn't reached sets the rate for all after it.
    rate = F.first(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    free = F.col("weight") * rate
    return rated.withColumn("target", F.when(free <= F.col("limit"), free).otherwise(F.col("limit").cast("double"))).select("source", "source_size", "weight", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def quotas(buckets: DataFrame, aims: DataFrame, seed: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a block: its place in the permutation, full passes, words of the rest that are taken of it, and the source's blocks.

    ``buckets`` has the words of each (source, bucket).
    """
    of = aims.select(F.col("source").alias("s"), "source_size", "target")
    blocks = (
        buckets.join(of, _same("source", "s"))
        .withColumn("n_blocks", _n_blocks(block_words))
        .withColumn("block", _block(F.col("bucket"), "n_blocks"))
        .groupBy("source", "block", "n_blocks", "source_size", "target")
        .agg(F.sum("words").alias("words"))
    )
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    permuted = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("block").cast("string")).cast("binary")), "block")
    want = F.round("target").cast("bigint")
    running = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.pmod(want, F.col("source_size"))).otherwise(0)
    return blocks.select(
        "source",
        "block",
        "n_blocks",
        "words",
        (F.row_number().over(permuted) - 1).cast("bigint").alias("place"),
        F.count("*").over(Window.partitionBy("source")).alias("there"),
        F.when(F.col("source_size") > 0, F.floor((want - rest) / F.col("source_size"))).otherwise(0).cast("bigint").alias("passes"),
        F.least(F.greatest(rest - running, F.lit(0)), F.col("words")).cast("bigint").alias("part"),
    )


# --- the tree ------------------------------------------------------------------------------------


def _log_factorial(n: Column) -> Column:
    """ln n!: from a table below 16, by Stirling's series from there, right to the last digits."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    return F.when(n < 16, F.element_at(small, (n + 1).cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def uniform(*of: Column) -> Column:
    """A number in [0, 1) made of a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(2**53)) / F.lit(float(2**53))


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are drawn by ``n`` draws, at the quantile ``u``.

    Probabilities are added up from the smallest count on, each from the one before.
    """
    mean, spread = n * good / total, F.sqrt(n * good / total * (total - good) / total * (total - n) / F.greatest(total - 1, F.lit(1)))
    least, most = F.greatest(n + good - total, F.lit(0)), F.least(n, good)
    window = F.struct(
        F.greatest(least, F.floor(mean - DEVIATIONS * spread - 20)).cast("bigint").alias("a"),
        F.least(most, F.ceil(mean + DEVIATIONS * spread + 20)).cast("bigint").alias("z"),
    )

    def drawn(w: Column) -> Column:
        a, z = w["a"], w["z"]
        first = F.exp(_log_choose(good, a) + _log_choose(total - good, n - a) - _log_choose(total, n))
        start = F.struct(F.lit(0.0).alias("below"), first.alias("p"), a.alias("x"))

        def add(s: Column, k: Column) -> Column:
            below = s["below"] + s["p"]
            ratio = (good - k).cast("double") * (n - k) / ((k + 1).cast("double") * (total - good - n + k + 1))
            return F.struct(below.alias("below"), (s["p"] * ratio).alias("p"), F.when(below <= u, k + 1).otherwise(s["x"]).alias("x"))

        walked = F.aggregate(F.sequence(a, z - 1), start, add, lambda s: s["x"])
        return F.when(a >= z, a).otherwise(walked)

    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.transform(F.array(window), drawn)[0])


def left_quotas(quota: Column, total: Column, n: Column, node: Column, seed: int) -> Column:
    """A multivariate hypergeometric draw of ``n`` among ``total`` blocks with these quotas by source: an array beside ``quota``."""
    none = F.expr("cast(array() as array<bigint>)")
    start = F.struct(none.alias("out"), total.alias("total"), n.alias("n"))

    def add(s: Column, q: Column) -> Column:
        u = uniform(F.lit(seed), F.lit("split"), node, F.size(s["out"]))
        x = hypergeometric(s["total"], q, s["n"], u)
        step = F.transform(F.array(x), lambda x: F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["total"] - q).alias("total"), (s["n"] - x).alias("n")))
        return step[0]

    return F.aggregate(quota, start, add, lambda s: s["out"])


def split(root: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard and ``quota`` of each leaf; ``root`` is one row with ``quota``, an array of blocks by source.

    A node is a range of shards, [lo, hi).  Shard i gets the blocks from floor(i Q / K) on,
    so that shards differ by a block at most.
    """
    total = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, x: a + x)
    nodes = root.select("quota", total.alias("all"), F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"))
    first = lambda i: F.floor(i * F.col("all") / shards).cast("bigint")
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint")
        node = F.concat_ws("-", "lo", "hi")
        left = left_quotas(F.col("quota"), first(F.col("hi")) - first(F.col("lo")), first(mid) - first(F.col("lo")), node, seed)
        halves = nodes.withColumns({"mid": mid, "left": F.when(F.col("hi") - F.col("lo") > 1, left)})
        child = lambda q, lo, hi: F.struct(q.alias("quota"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        right = F.zip_with("quota", "left", lambda q, x: q - x)
        both = F.when(F.col("left").isNull(), F.array(child(F.col("quota"), "lo", "hi"))).otherwise(F.array(child(F.col("left"), "lo", "mid"), child(right, "mid", "hi")))
        nodes = halves.select("all", F.explode(both).alias("c")).select("c.quota", "all", "c.lo", "c.hi")
        if level % 6 == 5:  # one row has become 64
            nodes = nodes.repartition("lo")
    return nodes.select(F.col("lo").alias("shard"), "quota")


def drawn(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, block, n_blocks and ``draws``: shard and words of each time the block is drawn.

    A source's draws are its blocks in permuted order, pass after pass; its shards take
    runs of them, one after the other.
    """
    spent = F.max(F.when(F.col("part") > 0, F.col("place") + 1).otherwise(0))
    per_source = blocks.groupBy("source").agg((F.first("passes") * F.first("there") + spent).alias("quota"))
    listed = per_source.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.col("source"), "quota"))).alias("s"))
    root = listed.select("s", F.transform("s", lambda x: x["quota"]).alias("quota"))
    leaves = split(root.select("quota"), shards, seed)
    by_source = leaves.select("shard", F.posexplode("quota").alias("i", "n"))
    end = F.sum("n").over(Window.partitionBy("i").orderBy("shard"))
    runs = by_source.withColumn("end", end).filter("n > 0").select("i", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("at"))
    names = root.select(F.posexplode("s").alias("i", "x")).select("i", F.col("x.source").alias("s"))
    places = runs.join(names, "i").select("s", "at", "shard")
    passed = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    full = F.transform(passed, lambda i: F.struct((i * F.col("there") + F.col("place")).alias("at"), F.col("words").alias("words"), F.lit(False).alias("cut")))
    cut_here = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    rest = F.when(F.col("part") > 0, F.array(F.struct((F.col("passes") * F.col("there") + F.col("place")).alias("at"), F.col("part").alias("words"), cut_here.alias("cut"))))
    none = F.expr("cast(array() as array<struct<at:bigint,words:bigint,cut:boolean>>)")
    each = blocks.select("source", "block", "n_blocks", F.explode(F.concat(full, F.coalesce(rest, none))).alias("d"))
    placed = each.select("source", "block", "n_blocks", "d.*").join(places.withColumnRenamed("at", "p"), _same("source", "s") & (F.col("at") == F.col("p")))
    return placed.groupBy("source", "block", "n_blocks").agg(F.array_sort(F.collect_list(F.struct("at", "shard", "words", "cut"))).alias("draws"))


def plan(rows: DataFrame, seed: int = 0, *, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target, ``draws`` (shard, and words taken of the document) and ``taken``, the sum of these words."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    buckets = scratch.cut(rows.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("words")))
    aims = cut(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most))
    blocks = scratch.cut(quotas(buckets, aims, seed, block_words))
    words = aims.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shards = max(1, math.ceil(words / shard_words))
    known = cut(drawn(blocks, shards, seed))
    scratch.clear()

    of = aims.select(F.col("source").alias("s"), "source_size", "target", _n_blocks(block_words).alias("__blocks"))
    homed = rows.join(of, _same("source", "s")).drop("s").withColumn("__block", _block(_bucket(), "__blocks"))
    draws = known.select(F.col("source").alias("s"), F.col("block").alias("b"), "draws")
    met = homed.join(draws, _same("source", "s") & (F.col("__block") == F.col("b")), "left").drop("s", "b")
    cut_words = F.get(F.filter("draws", lambda d: d["cut"]), F.lit(0))["words"]
    # Only the documents of a block that is taken in part need their order.
    whole = met.filter(F.coalesce(cut_words, F.lit(-1)) < 0).withColumn("__part", F.col("size"))
    order = Window.partitionBy("source").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = cut_words - F.coalesce(F.sum("size").over(order), F.lit(0))
    partly = met.filter(F.coalesce(cut_words, F.lit(-1)) >= 0).withColumn("__part", F.greatest(F.lit(0), F.least(left, F.col("size"))))
    own = F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), d["at"].alias("at"), F.when(d["cut"], F.col("__part")).otherwise(F.col("size")).alias("words")))
    none = F.expr("cast(array() as array<struct<shard:bigint,at:bigint,words:bigint>>)")
    found = whole.unionByName(partly).withColumn("draws", F.coalesce(own, none))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return found.withColumn("taken", taken).drop("__blocks", "__block", "__part")


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mixed documents: ``docs`` as often as they are drawn, with ``shard`` and ``words``, shuffled within each shard.

    The text of a document that is cut ends after its last word that is taken.
    """
    kept = docs.drop(*ADDED, "shard", "words", "hash")
    rows = plan(sized(kept, seed), seed, **options)
    each = rows.select(*kept.columns, "size", "hash", F.explode("draws").alias("d")).filter("d.words > 0")
    start = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("d.words"), F.lit("}+"))
    text = F.when(F.col("d.words") < F.col("size"), F.regexp_substr("text", start)).otherwise(F.col("text"))
    out = each.withColumns({"text": text, "shard": F.col("d.shard"), "words": F.col("d.words"), "__order": F.xxhash64(F.lit(seed), F.lit("mix"), "hash", "d.at")})
    return out.repartition("shard").sortWithinPartitions("shard", "__order").select(*kept.columns, "shard", "words")
