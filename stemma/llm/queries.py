"""The driver's queries: each applies one operator to its whole table and shapes the result.

``queries()`` and ``oracle_sql()`` are merged into the entry point's by name.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    decontaminate,
    divergence,
    filter_audit,
    language_id,
    mixing,
    near_duplicates,
    pii,
    quality_model,
    quality_rules,
    secrets,
    token_counts,
    token_files,
)
from ._common import cut, table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
UNIGRAMS = public_tokenizers.path("piece_bpe_32k.model")
#: The queries' key; a production run passes its own secret.
PII_KEY = b"example key of the queries"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_model.classify(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", "lang", "perplexity", "n_words", (~F.col("rejected")).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).drop("text")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85).drop("text_hash")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER, folder)
    return token_files.read(spark, folder)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, UNIGRAMS).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.join_back(docs, secrets.scan(docs))
    base = F.filter("findings", lambda f: F.split(f["rule"], "@")[0].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: F.split(f["rule"], "@")[0] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("findings")).alias("spans"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_decode(docs, BYTE_RANKS, PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(mixing.sized(table(spark, sf_dir, "documents"), 0).select("doc_id", "source", "size", "hash"))
    return mixing.plan(rows).select("doc_id", "size", "source_size", "target", "taken")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = rf"""
with words as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), windows as (
  select distinct item_id, least(10, len(w)) as k,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from items where len(w) > 0)
), lengths as (select distinct k from windows),
grams as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, lengths where len(w) >= k)
), found as (select doc_id, k, i, item_id from grams join windows using (k, g)),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, k, i from found)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
  from (select distinct doc_id, item_id::varchar as s from found) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""

OP3_SQL = r"""
with words as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select doc_id, i, array_to_string(w[i : i + 7], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)
), often as (
  select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1
), repeats as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from often) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct l) as n from (
    select doc_id, unnest(string_split(t, chr(10))) as l from words
  ) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id
), base as (
  select doc_id, t, w, len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from words left join repeats using (doc_id) left join lines using (doc_id)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed
    or 5 * n_symbols > n_words
    or word_chars < 2 * n_words
    or word_chars > 16 * n_words
    or n_dup_lines > 2 and 10 * n_dup_lines > 3 * len(string_split(t, chr(10)))
    or 2 * strlen(regexp_replace(t, '[^A-Z]', '', 'g')) > strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))
    or 5 * len(list_filter(w, lambda x: not regexp_matches(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]'))) > 2 * n_words
    or 5 * strlen(regexp_replace(t, '[^0-9]', '', 'g')) > word_chars) as kept
from judged
"""


OP5_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select distinct doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select x, y from pairs join sizes s on x = s.doc_id join sizes t on y = t.doc_id where 100 * common >= 85 * (s.n + t.n - common)
), edges as (select x, y from links union all select y, x from links),
reach as (
  select x as node, x as root from edges union select y, root from reach join edges on node = x where root < y
), roots as (select node, min(root) as root from reach group by node)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least(root, doc_id), doc_id) as component_id,
  coalesce(least(root, doc_id), doc_id) = doc_id as kept
from words left join sizes using (doc_id) left join roots on doc_id = node
"""


def _op9_sql() -> str:
    """One block for each rule, with the same patterns; only the ways to say "either case" and "taken for good" differ."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace(r"\"", '"').replace("'", "''").replace("*+", "*").replace(
            "(?i:(password|passwd|secret|token|api_?key))",
            "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])",
        )
        parts.append(
            f"""select doc_id, {i} as number, '{r.name}' as kind, {r.least} as least,
              list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) as own,
              list_transform(regexp_extract_all(t, '{pattern}', {r.group}), lambda x: length(x)) as part,
              list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) as gaps
            from docs where regexp_matches(t, '{pattern}')"""
        )
    base = ", ".join(f"'{x}'" for x in secrets.BASE)
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
matches as ({" union all ".join(parts)}),
spans as (
  select doc_id, number, kind, least, part[i] as part, own[i] as own,
    (list_sum(gaps[1:i]) + coalesce(list_sum(own[1:i - 1]), 0))::bigint as start
  from (select *, unnest(range(1, len(own) + 1)) as i from matches)
), kept as (
  select doc_id, number, kind, start, kind || ':' || start || ':' || (start + own) as s from spans where part >= least
), found as (
  select doc_id, string_agg(s, ',' order by start, number) as spans,
    string_agg(s, ',' order by start, number) filter (kind in ({base})) as base,
    count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h
  from kept group by doc_id
)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found using (doc_id)
"""


OP11_SQL = rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), words as (select r, lang, source, unnest(w) as t from docs),
kept as (select lang, t, count(*)::hugeint as c from words group by lang, t having count(distinct r) >= 3),
langs as (select lang, count(*)::hugeint as v, sum(c)::hugeint as n from kept group by lang),
whole as (select lang, t, 1 + (1000000000::hugeint * (c + 1)) // (n + v) as q from kept join langs using (lang)),
groups as (select distinct lang, source from docs),
counts as (select lang, source, t, count(*)::hugeint as c from words join kept using (lang, t) group by all),
totals as (select lang, source, sum(c)::hugeint as n from counts group by all),
cells as (
  select g.lang, g.source, k.t, coalesce(c, 0) as c,
    1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (coalesce(totals.n, 0) + v) as p
  from groups g join (select lang, t from kept) k on g.lang = k.lang join langs on g.lang = langs.lang
    left join counts on counts.lang = g.lang and counts.source = g.source and counts.t = k.t
    left join totals on totals.lang = g.lang and totals.source = g.source
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from cells a join cells b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
), terms as (
  select c.lang, c.source, 'term' as part, c.t as item, (((p - q) * (p - q)) // q)::bigint as value
  from cells c join whole on c.lang = whole.lang and c.t = whole.t where c.c > 0 and p > q
)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 200
"""

OP12_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '')), 1, 15))::bigint as hash
  from documents
), sources as (
  select source, coalesce('=' || source, '-') as name, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from docs group by source
), rates as (
  select *, ((150 * sum(source_size) over ())::bigint / 100.0::double
      - coalesce(sum(2 * source_size) over before, 0)::bigint) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as rate
  from sources
  window before as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), rate as (
  select first(rate order by 2 * source_size / weight, source nulls last) as r from rates where rate * weight <= 2 * source_size
), targets as (
  select *, least(weight * r, (2 * source_size)::double) as target, greatest(1, least(65536, ceil(source_size / 4096)))::bigint as n_blocks
  from sources, rate
), rows as (
  select doc_id, docs.source, name, size, hash, source_size, target, ((hash % 65536) * n_blocks) // 65536 as block,
    case when source_size > 0 then round(target)::bigint // source_size else 0 end as passes,
    case when source_size > 0 then round(target)::bigint % source_size else 0 end as rest
  from docs join targets on docs.source is not distinct from targets.source
), blocks as (
  select name, block, coalesce(sum(words) over (partition by name order by md5('0:order:' || name || ':' || block::varchar)
    rows between unbounded preceding and 1 preceding), 0) as before
  from (select name, block, sum(size) as words from rows group by all)
), ordered as (
  select *, before + coalesce(sum(size) over (partition by name, block order by hash, doc_id
    rows between unbounded preceding and 1 preceding), 0) as start
  from rows join blocks using (name, block)
)
select doc_id, size, source_size, target, (passes * size + least(size, greatest(0, rest - start)))::bigint as taken from ordered
"""

OP13_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), firsts as (select t, min(doc_id) as first from docs group by t),
masks as (
  select r, doc_id, part,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask
  from docs join firsts using (t)
), given as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic
  from labels where doc_id is not null group by doc_id
), counts as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from masks left join given using (doc_id) group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select filter_order, step::int as step, (1 << (ascii(filter_order[step]) - 65))::int as bit,
    list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65))::int)) as earlier
  from orders, (select unnest(range(1, 6)) as step)
), coded as (select filter_order, step, bit, coalesce(earlier, 0)::int as before from steps)
select part, filter_order, step,
  coalesce(sum(n) filter (mask & (bit | before) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (mask & bit <> 0), 0)::bigint as shapley
from counts, coded group by all
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_token_files": op6_token_files,
        "op7_token_counts": op7_token_counts,
        "op8_decontamination": op8_decontamination,
        "op9_secret_scan": op9_secret_scan,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_source_divergence": op11_source_divergence,
        "op12_source_mixing": op12_source_mixing,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_secret_scan": _op9_sql(), "op11_source_divergence": OP11_SQL, "op12_source_mixing": OP12_SQL, "op13_filter_audit": OP13_SQL}
