"""Source divergence, source mixing and the filter audit against brute force and on awkward tables."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import divergence, filter_audit, mixing, secrets
from stemma.llm._common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "red Green blue über naïve stone river cloud lamp wood ANT bee cat 日本 dog".split()


def corpus(n=120, seed=3, sources=("a", "b", None, "", "é", "zz", "c", "d", "e", "f", "g")):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(1, 90)), p=np.arange(1, 16) / 120))
        out.append((i, text, ("en", "de", None)[i % 7 % 3], sources[int(rng.integers(len(sources)))], len(text)))
    out += [(n, None, "en", "void", None), (n + 1, "", "xx", "only", 0), (n + 2, "123 ?", None, None, 5), (n + 3, "rare wörd", "xx", "other", 9)]
    out += [out[0], out[0], (None, out[1][1], "en", "a", 1), (None, None, None, None, None), (n + 4, "word " * 60_000, "en", "a", 0)]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("size", "taken", "draws", "mask", "term", "value", "part")}).repartition(5)


EMPTY = {
    "divergence": lambda d, l: divergence.divergence(d),  # noqa: E741
    "mixing": lambda d, l: mixing.mix(d),  # noqa: E741
    "audit": lambda d, l: filter_audit.audit(d, l),  # noqa: E741
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, name):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert EMPTY[name](spark.createDataFrame([], DOCS), labels).collect() == []


# --- 11 ----------------------------------------------------------------------------------------


def divergences(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        df = Counter(t for x in own for t in set(x[2]))
        kept = [t for t in df if df[t] >= least]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if df[w] >= least)
            counts[None].update(w for w in words if df[w] >= least)
        p = {s: {t: 1 + 10**9 * (counts[s][t] + 1) // (sum(counts[s].values()) + len(kept)) for t in kept} for s in {x[1] for x in own} | {None}}
        for s in {x[1] for x in own}:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o not in (s, None)]
            terms = [((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


@pytest.mark.parametrize(("terms", "seat", "entries", "top"), [(8192, 4, 200_000, 200), (2, 1, 3, 2), (3, 2, 1, 5), (1, 64, 10, 1)])
def test_divergence_against_brute_force(docs, rows, monkeypatch, terms, seat, entries, top):
    """Also with shards, seats and task counts so small that all ways meant for large tables are taken."""
    for name, value in (("SHARD_TERMS", terms), ("SEAT", seat), ("ENTRIES", entries), ("PIECE", 1000)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.divergence(docs, top=top).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == divergences(rows, top=top)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13])
def test_each_pair_of_seats_meets_once(spark, n):
    groups = spark.range(n).select(F.col("id").alias("seat"), F.lit(n).cast("bigint").alias("seats"))
    stops = divergence.travels(groups).select("seat", F.explode("stops").alias("s")).select("seat", "s.*").collect()
    assert sorted(r.seat for r in stops if r["round"] == -1 and r.host == r.seat) == list(range(n))
    met = [tuple(sorted((r.seat, r.host))) for r in stops if r["round"] >= 0]
    assert sorted(met) == list(itertools.combinations(range(n), 2))
    busy = Counter(x for r in stops if r["round"] >= 0 for x in ((r["round"], r.seat), (r["round"], r.host)))
    assert not busy or max(busy.values()) == 1  # a seat has one meeting a round
    visits = Counter(r.host for r in stops if r["round"] >= 0)
    assert not visits or max(visits.values()) <= n // 2 + 1


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 1, divergence.NARROW, divergence.NARROW + 1, 2**60], np.int64)
    for total, v in ((2**61, 10**6), (2**62 + 5, 3)):
        assert divergence.shares(n, total, v).tolist() == [1 + 10**9 * (int(x) + 1) // (total + v) for x in n]


# --- 12 ----------------------------------------------------------------------------------------


def waterfill(sizes, weights, percent, most):
    """Shares by weight; what is above the limit is shared anew among the others until nothing is."""
    left, free, out = percent * sum(sizes) / 100, set(range(len(sizes))), {}
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            return out | {i: left * weights[i] / total for i in free}
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(most * sizes[i] for i in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 500, 3, 0], [0, 0], [7], [5, 400, 30, 2, 2, 900, 41, 8]])
def test_targets_against_rounds_of_resharing(spark, sizes):
    names = [*(chr(97 + i) for i in range(len(sizes) - 1)), None]
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint").repartition(3)
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = waterfill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 150, 2)
    assert all(math.isclose(got[names[i]], want[i], rel_tol=1e-12, abs_tol=1e-9) for i in want)


def test_mix_meets_its_targets(spark, docs, rows):
    options = {"block_words": 64, "shard_words": 500}
    plan = mixing.plan(mixing.sized(docs.drop("size", "taken", "draws"), 5), 5, **options).collect()
    again = mixing.plan(mixing.sized(docs.drop("size", "taken", "draws").repartition(2), 5), 5, **options).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.size, r.source_size, r.target, r.taken, str(r.draws))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert Counter(r.doc_id for r in plan) == Counter(r[0] for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in plan:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r["size"] and r.taken == sum(d.words for d in r.draws)
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for r in plan:
        assert r.source_size == size[r.source]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    cut = Counter(r.source for r in plan if any(0 < d.words < r["size"] for d in r.draws))
    assert max(cut.values(), default=0) <= 1
    # Shards hold the same number of blocks, within one.
    blocks = defaultdict(set)
    for r in plan:
        for d in r.draws:
            blocks[d.shard].add((r.source, d["at"]))
    assert len(blocks) > 20


def test_mixed_documents(spark, docs):
    options = {"block_words": 64, "shard_words": 500}
    plan = mixing.plan(mixing.sized(docs.drop("size", "taken", "draws"), 5), 5, **options).collect()
    out = mixing.mix(docs.drop("size", "taken", "draws"), 5, **options)
    got = out.collect()
    want = Counter((r.doc_id, d.shard, d.words) for r in plan for d in r.draws if d.words)
    assert Counter((r.doc_id, r.shard, r.words) for r in got) == want
    assert all(len((r.text or "").split()) == r.words for r in got)
    ids = [r.doc_id for r in got if r.shard == got[0].shard and r.doc_id is not None]
    assert len(ids) < 4 or ids != sorted(ids)


def test_split_keeps_quotas_and_sizes(spark):
    quota = [1000, 3, 0, 57, 211, 1]
    root = spark.createDataFrame([(quota,)], "quota array<bigint>")
    for shards in (1, 2, 7, 70):
        leaves = {r.shard: r.quota for r in mixing.split(root, shards, 9).collect()}
        assert sorted(leaves) == list(range(shards))
        assert np.array(list(leaves.values())).sum(axis=0).tolist() == quota
        q = sum(quota)
        assert all(sum(leaves[i]) == (i + 1) * q // shards - i * q // shards and min(leaves[i]) >= 0 for i in leaves)


@pytest.mark.parametrize(("total", "good", "n"), [(10, 4, 5), (1000, 30, 400), (50, 50, 20), (40, 0, 3), (7, 3, 7), (2_000_000, 900_000, 1_000_000)])
def test_hypergeometric_draws(spark, total, good, n):
    """The quantiles of a hypergeometric distribution, from exact integers where these are small."""
    grid = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    arguments = [F.lit(x).cast("bigint") for x in (total, good, n)]
    got = np.array([r[0] for r in grid.select(mixing.hypergeometric(*arguments, F.col("u"))).collect()])
    mean, var = n * good / total, n * good / total * (total - good) / total * (total - n) / (total - 1)
    assert (np.diff(got) >= 0).all() and abs(got.mean() - mean) <= 0.01 * math.sqrt(var) + 0.002 and abs(got.std() - math.sqrt(var)) <= 0.02 * math.sqrt(var) + 1e-9
    if total <= 1000:
        below, want, k = 0.0, [], max(0, n + good - total)
        for i in range(2000):
            while below + math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) <= (i + 0.5) / 2000:
                below += math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n)
                k += 1
            want.append(k)
        assert (got == want).mean() > 0.999


# --- 13 ----------------------------------------------------------------------------------------


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if x[j] == 1 and i is not None} for j in (0, 1))
    masks = []
    for i, text, _, source, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == t for o in rows)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        masks.append((source or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in own if f in m[1] and not m[1] & before]
                removed[f] += len(here)
                out[part, order, step] = (
                    sum(not m[1] & (before | {f}) for m in own), len(here), sum(f in m[1] and bool(m[1] & before) for m in own),
                    sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here),
                )
        for (p, order, step), x in out.items():
            if p == part and len(x) == 6:
                out[p, order, step] = (*x, removed[order[step - 1]])
    return out


def test_audit_against_brute_force(spark, rows):
    rng = np.random.default_rng(1)
    long = " ".join(f"word{i}" for i in range(3000))  # beyond both fixed blocks
    more = [(200, "A# " * 20, "en", "a", 0), (201, long, "en", "b", 0), (202, long, "en", "a", 0), (203, long[:-1] + "X", "en", "a", 0), (204, long[:100] + "X" + long[101:], "en", "a", 0)]
    more += [(300 + i, "same text " * 30, "en", "abc"[i % 3], 0) for i in range(40)] + [(50, rows[7][1], None, None, 0)]
    table = [*rows, *more]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 340, 3)] + [(None, 1, 1), (0, 0, None), (0, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(table, DOCS).withColumns({c: F.lit("mine") for c in ("mask", "size", "h0", "own", "class")}).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = got.collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(found) == 600 * len({r[3] or "" for r in table})
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in found} == audited(table, labels)


def test_equal_hashes_are_told_apart_by_text(spark, monkeypatch):
    """Texts of one length whose block hashes are all equal: the texts decide."""
    monkeypatch.setattr(filter_audit, "blocks", lambda text: [F.lit(7).cast("bigint").alias(f"h{i}") for i in range(3)])
    rows = [(5, "abc", "x"), (1, "abd", "x"), (9, "abc", "x"), (3, "abd", "y"), (4, "abe", "x"), (2, "longer", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    scratch = Scratch(spark)
    got = {r.doc_id: r.mask >= 16 for r in filter_audit.masks(docs, scratch).collect()}
    assert got == {5: False, 1: False, 9: True, 3: True, 4: False, 2: False}


# --- 9: long keys ------------------------------------------------------------------------------


@pytest.mark.parametrize("lines", [15_000, 160_000])
def test_private_keys_of_megabytes(spark, lines):
    """One and ten MB of key lines: matched without a stack frame a line."""
    body = "\n".join(["QUJD" * 16] * lines)
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\nQUI=\n-----END RSA PRIVATE KEY-----"
    text = f"before {key} after token=abcdefgh1234"
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id bigint, text string")
    found = secrets.join_back(docs, secrets.scan(docs))
    got = {r.doc_id: r for r in found.select("doc_id", secrets.listed(F.col("findings")).alias("spans"), F.length(secrets.redacted(F.col("text"), F.col("findings"))).alias("left")).collect()}
    at = text.index("token=")
    assert got[1].spans == f"private_key:7:{7 + len(key)},assign:{at}:{at + 18}"
    assert got[1].left == len("before [SECRET] after [SECRET]")
    assert got[2].spans.startswith("private_key:7:") and got[2].left < 100


