"""Secret scan with an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its content.  The
ledger holds which rules, by name and version, have seen which blob and what they
found.  A scan reads the text of one representative of each blob with unseen
pairs of blob and rule version, applies only those rules, adds the findings to
the ledger, and joins the ledger back to all versions that share the blob.  All
of it is DataFrame operations: Python sees no row.

Positions are code points, end exclusive.  A rule's matches are leftmost and
don't overlap; the text is split at them, so that the lengths of what lies
between and of the matches add up to the positions.

Edge cases: a null text is an empty one, and has no findings; copies and repeated
rows share one blob and all get its findings; an empty table returns no rows;
findings of different rules may overlap, and all are reported; a column ``findings``
of the versions is replaced; very long texts are scanned whole, in the JVM's memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` characters are asked of its group ``group``.  A new version scans every blob anew."""

    name: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


#: The first three are the base rules.  The others add formats that name themselves.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule(
        "private_key",
        # The lines are taken for good ("*+"): a matched group that could give some back is kept on the stack, a level for each line.
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[\r\n\t\x20]+[A-Za-z0-9+/=]{32,})*+(?:[\r\n\t\x20]+[A-Za-z0-9+/=]*[\r\n\t\x20]*-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
        1,
        version=3,
    ),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}", 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, findings array<struct<start:bigint,number:int,rule:string,end:bigint>>"
NOTHING = "cast(array() as array<struct<start:bigint,number:int,rule:string,end:bigint>>)"


def _blob(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _lengths(pattern: str, group: int, text: str) -> Column:
    """For each match: characters before it since the last one, of the match, and of its group."""
    sizes = lambda x: F.transform(x, F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of_group = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(
        sizes(F.split(text, pattern, -1)).alias("before"), sizes(found).alias("own"), sizes(of_group).alias("part")
    )
    return F.when(F.size(found) > 0, F.slice(zipped, F.lit(1), F.size(found)))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the rules named in ``todo`` find in ``text``: blob and its findings by place, for blobs with any.

    Rows that repeat a blob have the same matches, which are kept once before they are placed.
    """
    names = {"before": "int", "own": "int", "part": "int"}
    kind = f"array<struct<{','.join(f'{k}:{v}' for k, v in names.items())}>>"
    per_rule = [
        F.struct(
            F.lit(i).alias("number"),
            F.when(F.array_contains("todo", r.id), _lengths(r.pattern, r.group, "text")).cast(kind).alias("m"),
        )
        for i, r in enumerate(rules)
    ]
    some = blobs.select("blob", F.explode(F.array(*per_rule)).alias("x")).filter("x.m is not null")
    once = some.groupBy("blob", "x.number").agg(F.first("x.m").alias("m"))
    each = once.select("blob", "number", F.posexplode("m").alias("at", "m")).select("blob", "number", "at", "m.*")
    along = Window.partitionBy("blob", "number").orderBy("at")
    ends = each.withColumn("end", F.sum(F.col("before") + F.col("own")).over(along))
    least = reduce(lambda c, i: c.when(F.col("number") == i, rules[i].least), range(len(rules)), F)
    rule = reduce(lambda c, i: c.when(F.col("number") == i, rules[i].id), range(len(rules)), F)
    return (
        ends.filter(F.col("part") >= least)
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((F.col("end") - F.col("own")).alias("start"), "number", rule.alias("rule"), "end")
                )
            ).alias("findings")
        )
    )


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """New ledger rows for ``versions``: their blobs with unseen rule versions, the rules applied, and the findings.

    The rows are written to the shared folder and read back.  The representatives'
    texts move once, in a hash join on (key, blob) that needn't sort them.
    """
    every = F.array(*(F.lit(r.id) for r in rules))
    content = versions.select(F.col(key).alias("key"), _blob(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    todo = content.groupBy("blob").agg(F.min("key").alias("key")).withColumn("todo", every)
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = todo.join(seen, "blob", "left").select(
            "blob", "key", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
        )
    todo = todo.filter(F.size("todo") > 0)
    same = todo.withColumnRenamed("blob", "b").withColumnRenamed("key", "k")
    texts = content.join(same.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("k")) & (F.col("blob") == F.col("b")))
    found = findings(texts.select("blob", "todo", "text"), rules).groupBy("blob").agg(F.first("findings").alias("findings"))
    rows = todo.join(found, "blob", "left").select(
        "blob", F.col("todo").alias("rules"), F.coalesce("findings", F.expr(NOTHING)).alias("findings")
    )
    return cut(rows)


def join_back(versions: DataFrame, ledger: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``findings``, by place and then by rule, of the current versions of the rules."""
    current = F.array(*(F.lit(r.id) for r in rules))
    known = (
        ledger.filter(F.size("findings") > 0)
        .select("blob", F.explode("findings").alias("f"))
        .withColumn("number", F.array_position(current, F.col("f.rule")).cast("int") - 1)
        .filter("number >= 0")
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("f.start", "number", "f.rule", "f.end"))).alias("findings"))
    )
    kept = versions.drop("findings")
    return (
        kept.withColumn("__blob", _blob(text))
        .join(known.withColumnRenamed("blob", "__blob"), "__blob", "left")
        .select(*kept.columns, F.coalesce("findings", F.expr(NOTHING)).alias("findings"))
    )


def listed(found: Column) -> Column:
    """Findings as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", F.split(f["rule"], "@")[0], f["start"], f["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping findings replaced by ``mark``."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        before = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(last["end"] >= x["start"], F.concat(before, F.array(joined))).otherwise(
            F.concat(acc, F.array(span))
        )

    spans = F.aggregate(found, none, add)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    between = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("z")),
        lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["z"] - x["a"]).cast("int")),
    )
    return F.when(F.size(found) > 0, F.array_join(between, mark)).otherwise(text)
