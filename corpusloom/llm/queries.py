"""The opN queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import read_table
from .decontam import leaks
from .line_dedup import MIN_SITES, line_report
from .minhash import near_duplicates
from .packing import pack_documents
from .pii import find_personal_data
from .quality_classifier import score_documents
from .quality_rules import FENCE, METRICS, MIN_GROUP, judge_quality
from .suffix_dedup import remove_repeats
from .token_shards import sequence_digest, write_shards
from .warc import archive_round_trip


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_bytes")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_digest(*write_shards(read_table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_quality_rules, op3_line_dedup, op4_decontamination, op5_suffix_dedup, op6_token_shards, op7_warc, op8_packing, op9_quality_classifier, op10_minhash)
}

_WORDS = r"case when trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then []::varchar[] else regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') end"
_METRIC_SQL = {name: expr.replace(" div ", " // ") for name, (expr, _) in METRICS.items()}


def _quality_sql() -> str:
    values = " union all ".join(f"select lang, source, '{name}' as metric, cast({expr} as bigint) as v from counted where not base_failed" for name, expr in _METRIC_SQL.items())

    def cuts(level: str, keys: str) -> str:
        on = f"{keys}, " if keys else ""
        slack = "case metric " + " ".join(f"when '{n}' then {s}" for n, (_, s) in METRICS.items()) + " end"
        return f"""
{level}_run as (select {on}metric, bucket, sum(n) as n, sum(sum(n)) over (partition by {on}metric order by bucket) as upto, sum(sum(n)) over (partition by {on}metric) as total from sketch group by {on}metric, bucket),
{level}_q as (select {on}metric, max(total) as total, min(case when upto * 4 >= total then bucket end) as q25, min(case when upto * 4 >= total * 3 then bucket end) as q75 from {level}_run group by {on}metric),
{level}_cut as (select {on}metric, total, q75 + {FENCE} * (q75 - q25) + {slack} as cut from {level}_q)"""

    picked = ", ".join(
        f"max(case when metric = '{n}' then cut end) as cut_{n}" for n in METRICS
    )
    above = " or ".join(f"{expr} > cut_{n}" for n, expr in _METRIC_SQL.items())
    return rf"""
with w as (select *, {_WORDS} as words, coalesce(text, '') as t from documents),
grams as (select doc_id, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
named as (select doc_id, i, array_to_string(words[i:i+7], ' ') as gram from grams),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from named) where c > 1),
covered as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice) group by doc_id),
ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
counts as (select w.doc_id, lang, source, cast(len(words) as bigint) as n_words,
  cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from w join ln using (doc_id) left join covered using (doc_id)),
counted as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts),
vals as ({values}),
sketch as (select lang, source, metric, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) as bucket, count(*) as n from vals group by 1, 2, 3, 4),
{cuts("own", "lang, source")},{cuts("lang", "lang")},{cuts("whole", "")},
cut as (select o.lang, o.source, o.metric, case when o.total >= {MIN_GROUP} then o.cut when l.total >= {MIN_GROUP} then l.cut else a.cut end as cut
  from own_cut o left join lang_cut l on o.lang is not distinct from l.lang and o.metric = l.metric join whole_cut a on a.metric = o.metric),
wide as (select lang, source, {picked} from cut group by lang, source)
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce({above}, false) as kept,
  {", ".join(f"cast(cut_{n} as bigint) as cut_{n}" for n in METRICS)}
from counted c left join wide on c.lang is not distinct from wide.lang and c.source is not distinct from wide.source
"""


_LINES_SQL = f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
s as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l),
bad as (select key from s where key <> '' group by key having count(distinct source) >= {MIN_SITES}),
ranked as (select s.*, bad.key is not null as bad, row_number() over (partition by s.key order by doc_id, pos) as k from s left join bad on s.key = bad.key),
parts as (select doc_id, cast(count(*) filter (where key <> '') as bigint) as n_lines, cast(count(*) filter (where bad and k > 1) as bigint) as n_removed,
  coalesce(string_agg(line, chr(10) order by pos) filter (where not (bad and k > 1)), '') as rest from ranked group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, cast(length(coalesce(rest, '')) as bigint) as kept_chars, sha256(coalesce(rest, '')) as kept_sha256
from documents d left join parts using (doc_id)
"""

_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as last from pages),
h as (select *, sha1(html) as hex from p),
b as (select *, list_transform(range(40), lambda i: cast(instr('0123456789abcdef', hex[cast(i + 1 as int)]) - 1 as int)) as nib from h),
c as (select *, list_transform(range(32), lambda j: list_reduce(list_transform(range(5), lambda k: ((nib[cast((j * 5 + k) // 4 + 1 as int)] >> cast(3 - (j * 5 + k) % 4 as int)) & 1) << cast(4 - k as int)), lambda x, y: x + y)) as digits from b)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(digits, lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast(d + 1 as int)]), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id = last then null else last end as refers_to,
  case when page_id = last then hex end as payload_sha1
from c
"""

#: All pairs that share a shingle, and reachability over the links: for tables of a few thousand documents.
_NEAR_SQL = f"""
with recursive low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select doc_id, {_WORDS} as words from low),
s as (select doc_id, list_sort(list_distinct(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as grams from w),
n as (select doc_id, cast(len(grams) as bigint) as n_shingles, case when len(grams) > 0 then md5(array_to_string(grams, chr(10))) end as cls from s),
heads as (select cls, min(doc_id) as head, count(*) as class_size from n where cls is not null group by cls),
g as (select s.doc_id, n.n_shingles, unnest(grams) as gram from s join n using (doc_id) join heads on heads.head = s.doc_id),
link as (select a.doc_id as u, b.doc_id as v from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n_shingles, b.n_shingles having 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))),
edge as (select u, v from link union select v, u from link),
reach(u, v) as (select head, head from heads union select r.u, e.v from reach r join edge e on e.u = r.v),
comp as (select u as head, min(v) as component_id from reach group by u)
select n.doc_id, n.n_shingles, coalesce(c.component_id, n.doc_id) as component_id, coalesce(h.class_size, 1) as class_size, n.doc_id = coalesce(c.component_id, n.doc_id) as kept
from n left join heads h on h.cls = n.cls left join comp c on c.head = h.head
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _quality_sql(), "op3_line_dedup": _LINES_SQL, "op7_warc": _WARC_SQL, "op10_minhash": _NEAR_SQL}
